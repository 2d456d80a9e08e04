"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact check on full shingle sets.

1. One pass over the texts gives each document's set size, a digest of the set and a
   MinHash signature. Documents of one set are one class, so exact copies cost one row.
2. Classes that share a band are candidates; a cluster is what shared bands connect. A cluster
   of at most CLUSTER classes is compared in one group, a larger one bucket by bucket, and a large
   bucket block by block, so no group holds more than two blocks. No pair becomes a row.
3. In a group, the signatures of all candidate pairs are compared batch by batch. With a uniform
   prior the similarity after m equal of n places is Beta(m+1, n-m+1); a pair goes once its
   chance of reaching the threshold is under MISS. The rest, likeliest first, are checked on their
   full sets unless links of the group already join them. A group returns a spanning forest.
4. Components of all forests are the near-duplicate groups.

Bands of ROWS among BANDS * ROWS values: two sets of similarity 0.8 share none with a chance of 7e-5, of 0.85 with 8e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import Bloom, components, hash_words, materialize, mix64, text_batches, text_slices, window_hashes

SHINGLE, PERCENT = 5, 80
BANDS, ROWS, BATCH, MISS = 24, 5, 24, 1e-5
#: Classes of a group, and bytes of their full sets, about.
CLUSTER, GROUP_BYTES = 512, 16 << 20
#: Parts that the members of a bucket are dealt to while they get their blocks.
SALTS = 64
SIGNATURE = BANDS * ROWS


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; of fewer than k words, the whole sequence as one."""
    out: list[np.ndarray] = []
    for a, b in text_slices(texts):
        words, first = hash_words(texts[a:b], lower=True)
        windows = window_hashes(words, k)
        for s, e in zip(first[:-1], first[1:]):
            if e - s >= k:
                out.append(np.unique(windows[s : e - k + 1]))
            elif e > s:
                out.append(window_hashes(words[s:e], e - s, seed=e - s))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def minhash(sets: list[np.ndarray], n: int = SIGNATURE) -> np.ndarray:
    """One row of n 32-bit values per set; of an empty set, zeros."""
    sig = np.zeros((len(sets), n), np.uint32)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    a, b = _permutations(n)
    at = 0
    while at < len(full):
        to, size = at, 0
        while to < len(full) and (to == at or size + len(sets[full[to]]) <= 1 << 18):
            size += len(sets[full[to]])
            to += 1
        rows = full[at:to]
        h = np.concatenate([sets[i] for i in rows])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in rows])[:-1]))
        for j in range(n):
            sig[rows, j] = np.minimum.reduceat(((h * a[j] + b[j]) >> np.uint64(32)).astype(np.uint32), starts)
        at = to
    return sig


def least_equal(percent: int, miss: float = MISS, batch: int = BATCH, n: int = SIGNATURE) -> list[tuple[int, int]]:
    """(values compared, least number of them equal): below, P(similarity >= percent/100 | equal) < miss."""
    t, out = percent / 100, []
    for size in range(batch, n + 1, batch):
        tail, m = 0.0, -1
        while m < size and tail < miss:
            m += 1
            # P(J >= t) under Beta(m+1, size-m+1) is P(Binomial(size+1, t) <= m)
            tail += comb(size + 1, m) * t**m * (1 - t) ** (size + 1 - m)
        out.append((size, m))
    return out


def profiles(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set; null if empty), sig."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = shingle_sets(b["text"].tolist(), k)
            sig = minhash(sets)
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "n_shingles": [len(s) for s in sets],
                "set_key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sig": [r.tobytes() for r in sig],
            })

    return docs.mapInPandas(work, "doc_id long, n_shingles long, set_key binary, sig binary")


def _bands(sig: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands, one column each."""
    rows = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + rows[:, :, j])
    return h.view(np.int64)


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), SIGNATURE)


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): one row a band."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": _bands(_signatures(b["sig"])).ravel(), "rep": np.repeat(b["rep"].to_numpy(np.int64), BANDS)})

    return classes.select("rep", "sig").mapInPandas(work, "key long, rep long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, sig, shingles) of the documents in wanted (rep), and perhaps of a few more."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted, "rep", wanted.count()))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].astype("Int64")
            at = np.flatnonzero(ids.notna().to_numpy())
            at = at[bloom.value.has(ids.iloc[at].to_numpy(np.int64))]
            sets = shingle_sets(b["text"].iloc[at].tolist(), k)
            yield pd.DataFrame({"rep": ids.iloc[at].to_numpy(np.int64), "sig": [r.tobytes() for r in minhash(sets)], "shingles": [s.tobytes() for s in sets]})

    return docs.mapInPandas(work, "rep long, sig binary, shingles binary")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _candidates(bands: np.ndarray, key: int | None, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that share a band; with key, those that share no band before the key's. side: only pairs across."""
    if key is None:
        shared = np.zeros((len(bands), len(bands)), bool)
        for c in range(BANDS):
            shared |= bands[:, c, None] == bands[None, :, c]
    else:
        own = int(np.flatnonzero((bands == key).all(0))[0])
        shared = np.ones((len(bands), len(bands)), bool)
        for c in range(own):
            shared &= bands[:, c, None] != bands[None, :, c]
    if side is not None:
        shared &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(shared, 1))


def verify(sig: np.ndarray, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs' links: sequential pruning on signatures, then full sets, likeliest first."""
    steps = least_equal(percent)
    left, equal = [], []
    for at in range(0, len(i), 100_000):
        a, b = i[at : at + 100_000], j[at : at + 100_000]
        idx, same, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
        for size, least in steps:
            same = same + (sig[a[idx], done:size] == sig[b[idx], done:size]).sum(1)
            ok = same >= least
            idx, same, done = idx[ok], same[ok], size
        left.append(idx + at)
        equal.append(same)
    if not left:
        return []
    rest, equal = np.concatenate(left), np.concatenate(equal)
    forest, links = _Forest(len(sets)), []
    for p in rest[np.argsort(-equal, kind="stable")]:
        a, b = int(i[p]), int(j[p])
        if forest.root(a) == forest.root(b):
            continue
        small, large = sorted((len(sets[a]), len(sets[b])))
        if 100 * small < percent * large:
            continue
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= percent * (small + large - common):
            forest.join(a, b)
            links.append((a, b))
    return links


def _compare(percent: int):
    def work(group: tuple, f: pd.DataFrame) -> pd.DataFrame:
        whole, key, low, high = group
        f = f.sort_values("rep").drop_duplicates("rep")
        sig, rep = _signatures(f["sig"]), f["rep"].to_numpy(np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in f["shingles"]]
        i, j = _candidates(_bands(sig), None if whole else int(key), f["block"].to_numpy() if low != high else None)
        links = verify(sig, sets, i, j, percent)
        return pd.DataFrame({"a": [rep[x] for x, _ in links], "b": [rep[y] for _, y in links]}, dtype=np.int64)

    return work


def link_classes(docs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): links between representatives of different sets that leave no component unconnected."""
    bands = band_keys(classes)
    often = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("first")).where("n > 1")
    shared = materialize(bands.join(often, "key").select("key", "rep", "first"), "bands")
    clusters = components(shared, "rep", "first")
    sets = materialize(full_sets(docs, clusters.select(F.col("node").alias("rep")), k), "sets")
    weights = classes.select("rep", (F.col("n_shingles") * 8).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / CLUSTER), F.ceil(F.col("bytes") / GROUP_BYTES)).cast("int").alias("blocks")
    size = [F.count("*").alias("n"), F.sum("bytes").alias("bytes")]
    member = materialize(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(weights, "rep"), "members")
    of = member.groupBy("cluster").agg(*size).select("cluster", blocks)
    member = member.join(of, "cluster")
    small = member.where("blocks = 1").select(F.lit(True).alias("whole"), F.col("cluster").alias("key"), "rep", "blocks")
    split = shared.select("key", "rep").join(member.where("blocks > 1").select("rep", "bytes"), "rep").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(SALTS).cast("long")))
    # only buckets of several blocks are looked up, and a bucket's members meet them under SALTS keys
    sized = split.groupBy("key").agg(*size).select("key", blocks).where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    large = split.join(sized, ["key", "salt"], "left").select(F.lit(False).alias("whole"), "key", "rep", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    rows = (
        small.unionByName(large)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("whole", "key", "rep", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    return rows.join(sets, "rep").groupBy("whole", "key", "low", "high").applyInPandas(_compare(percent), "a long, b long")


def deduplicate(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Two documents are linked if
    100 * common >= percent * all of their shingle sets. An empty or null text has an empty set and, like a row with a
    null doc_id, is linked with nothing. Rows repeated under one doc_id share their component and their `kept`;
    doc_ids are taken to stand for one text. An empty table gives no rows.
    """
    docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = materialize(profiles(docs, k), "profiles")
    of_set = own.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("set_key")
    classes = materialize(of_set.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    links = materialize(link_classes(docs, classes, percent, k), "found")
    found = components(links, "a", "b")
    of_class = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    joined = own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id, and without repeats of a doc_id; columns and their order stay.

    Empty and null texts and rows with a null doc_id all stay; columns may have any names; an empty table stays empty.
    """
    found = deduplicate(docs, percent, k)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(["`" + c.replace("`", "``") + "`" for c in docs.columns])
    again = materialize(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeats")
    if again.limit(1).count():
        left = left.dropDuplicates(["doc_id"]) if not docs.where("doc_id IS NULL").limit(1).count() else left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id IS NULL"))
    return left
