"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors serves as pivots. Each vector is described by its DEPTH most
similar pivots in order; inverted lists hold, per label and pivot, the vectors that have it
there. Vectors that share SHARED pivots or more are candidates, and a candidate pair is
verified by its cosine in double precision, in the list of its smallest shared pivot.
Equal vectors of a label are one entry with a count. Every vector is indexed: the OWN_LENGTHS commonest
vector lengths have pivots of their own, all others share pivots that are cut to their length. The pivots
alone come from a sample: PIVOTS_MOST at most, and at most PIVOT_FLOATS numbers, no two of
them nearer than APART, so that a large group of near copies holds a few pivots and not its
share of them. Its members then have the same few pivots, and all their pairs are compared.

Lists of one entry go before vectors are moved. Lists are dealt out in blocks of BLOCK entries, and block pairs are compared as matrices, so
neither a list nor its pairs meet in one row or task; links leave a block pair as counts and
as one star per component of the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import components, materialize

COSINE, DEPTH, SHARED = 0.98, 8, 2
PIVOTS_LEAST, PIVOTS_MOST, PIVOT_FLOATS = 32, 16_384, 1 << 23
#: No two pivots have this cosine or more.
APART = 0.9
OWN_LENGTHS = 64
BLOCK = 1024


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def unit(rows: list[np.ndarray]) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    m = m / np.abs(m).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def thin(rows: np.ndarray, most: int) -> np.ndarray:
    """The first rows, at most `most`, each under APART to those before it that stay."""
    kept = rows[:0]
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        part = part[(part @ kept.T).max(1, initial=-1) < APART]
        near = part @ part.T >= APART
        stay: list[int] = []
        for i in range(len(part)):
            if not near[i, stay].any():
                stay.append(i)
        kept = np.concatenate((kept, part[stay]))[:most]
        if len(kept) == most:
            break
    return kept


def sample_pivots(classes: DataFrame, n: int, dim: int) -> np.ndarray:
    """At most about 2 * sqrt(n) vectors, the first by a hash of their ids that are APART, of four times as many; shorter ones are padded with zeros to dim."""
    bound = max(1, min(PIVOTS_MOST, PIVOT_FLOATS // max(dim, 1)))
    most = int(min(bound, max(PIVOTS_LEAST, 2 * n**0.5)))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(min(bound, 4 * most)).select("v").toArrow().to_pandas()["v"]
    return thin(unit([np.pad(np.asarray(v, np.float64), (0, dim - len(v))) for v in rows]), most)


def _floats(classes: DataFrame) -> type:
    return np.float32 if classes.schema["v"].dataType.elementType.typeName() == "float" else np.float64


def _postings(classes: DataFrame, pivots: dict[int, np.ndarray], depth: int) -> DataFrame:
    """pivots: by length; under 0 those of all other lengths."""
    held = classes.sparkSession.sparkContext.broadcast(pivots)
    kind_of_float = _floats(classes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby(b["v"].map(len)):
                p = held.value[dim] if dim in held.value else held.value[0][:, :dim]
                for at in range(0, len(part), 2048):
                    rows = part.iloc[at : at + 2048]
                    near = unit(rows["v"].tolist()) @ p.T
                    k = min(depth, len(p))
                    top = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1).astype(np.int32)
                    yield pd.DataFrame({
                        "label": np.repeat(rows["label"].to_numpy(), k), "dim": dim, "pivot": top.ravel(), "rep": np.repeat(rows["rep"].to_numpy(np.int64), k),
                        "copies": np.repeat(rows["copies"].to_numpy(np.int64), k), "perm": np.repeat(np.array([r.tobytes() for r in top], object), k),
                        "vec": np.repeat(np.array([np.asarray(v, kind_of_float).tobytes() for v in rows["v"]], object), k),
                    })

    kind = classes.schema["label"].dataType.simpleString()
    return classes.mapInPandas(work, f"label {kind}, dim int, pivot int, rep long, copies long, perm binary, vec binary")


def _compare(cosine: float, shared: int, kind_of_float: type):
    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        pivot, left, right = key[2], key[3], key[4]
        f = f.sort_values("rep")
        perm = np.frombuffer(b"".join(f["perm"]), np.int32).reshape(len(f), -1)
        vec = unit(list(np.frombuffer(b"".join(f["vec"]), kind_of_float).reshape(len(f), -1)))
        local, code = np.unique(perm, return_inverse=True)
        has = np.zeros((len(f), len(local)), np.float32)
        np.put_along_axis(has, code.reshape(perm.shape), 1, axis=1)
        lower = has[:, local < pivot]
        both = (vec @ vec.T >= cosine) & (has @ has.T >= min(shared, perm.shape[1])) & (lower @ lower.T == 0)
        np.fill_diagonal(both, False)
        if left != right:
            side = f["block"].to_numpy()
            both &= side[:, None] != side[None, :]
        rep, copies = f["rep"].to_numpy(np.int64), f["copies"].to_numpy(np.int64)
        hit = np.flatnonzero(both.any(1))
        both = both[np.ix_(hit, hit)]
        root = np.arange(len(hit))
        while True:
            low = np.minimum(root, np.where(both, root[None, :], len(hit)).min(1)) if len(hit) else root
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"rep": rep[hit], "n": both @ copies[hit] if len(hit) else np.zeros(0, np.int64), "root": rep[hit][root]})

    return work


def link_classes(classes: DataFrame, cosine: float = COSINE, depth: int = DEPTH, shared: int = SHARED) -> DataFrame:
    """(rep, n, root) per block pair: how many vectors a class is linked to there, and a member of the same component."""
    size = F.size("v")
    dims = [(r.dim, r.n) for r in classes.groupBy(size.alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(OWN_LENGTHS).collect()]
    pivots = {d: sample_pivots(classes.where(size == d), n, d) for d, n in dims}
    others = classes.where(~size.isin([d for d, _ in dims]))
    n, longest = others.agg(F.count("*"), F.max(size)).first() if len(dims) == OWN_LENGTHS else (0, None)
    if n:
        pivots[0] = sample_pivots(others, n, longest)
    postings = _postings(classes, pivots, depth)
    lists = ["label", "dim", "pivot"]
    sizes = postings.groupBy(*lists).agg(F.count("*").alias("n")).where("n > 1").select(*lists, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (
        postings.join(sizes, lists)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    return dealt.groupBy(*lists, "low", "high").applyInPandas(_compare(cosine, shared, _floats(classes)), "rep long, n long, root long")


def deduplicate(vectors: DataFrame, cosine: float = COSINE, depth: int = DEPTH, shared: int = SHARED) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    vectors needs vec_id, embedding, label; other columns are ignored. Vectors with a null id or label, or that are
    not `usable`, link with nothing; only vectors of one length link.
    Rows of one vec_id count as vectors of their own but share a component. An empty table gives no rows.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    v = v.withColumn("ok", F.coalesce(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    v = v.withColumn("k1", F.when(F.col("ok"), F.xxhash64("v", "label"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(7), "label", "v")))
    classes = materialize(v.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")
    found = materialize(link_classes(classes, cosine, depth, shared), "found")
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found, "rep", "root")
    per_class = classes.select("k1", "k2", "rep", "copies").join(linked, "rep", "left").join(comp, F.col("node") == F.col("rep"), "left")
    per_class = per_class.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = v.select("vec_id", "k1", "k2").join(per_class, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
