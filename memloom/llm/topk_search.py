"""Exact top-k inner products by distributed histogram selection.

Vectors become integers, floor(scale * x), kept as doubles, which hold them exactly. Queries go in waves of
at most WAVE_QUERIES vectors and BROADCAST_BYTES, and a wave is broadcast; candidates are scanned where they lie, so
histograms alone are shuffled. Every pass scores all pairs of a query and another vector as matrix
products and counts, per query, the scores in BINS equal bins of the range that still holds the k-th one;
tasks send no bin below their own k-th score, since the k-th of all is never lower. The bin of
the k-th score is the next pass's range, until it is one score wide. A last pass keeps what is above
that score and, of its ties, each task's smallest ids. Nothing about a query depends on how many
vectors tie. The driver holds a wave's ranges and nothing of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import materialize

BINS, QUERY_BLOCK, CHUNK = 2048, 1024, 1024
#: Bounds of a wave of queries, which is broadcast: vectors, and bytes of them.
WAVE_QUERIES, BROADCAST_BYTES = 1 << 16, 32 << 20
#: Bytes of candidates that a task scores before it sends its counts.
BUNCH_BYTES = 32 << 20
SCHEMA = "query_id long, rank int, vec_id long, score long"


def usable(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _integers(rows: list[np.ndarray], scale: float, dim: int) -> np.ndarray:
    m = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    with np.errstate(over="ignore"):
        m = np.floor(m * scale)
    if not np.isfinite(m).all():
        raise OverflowError("a scaled component leaves the range of doubles")
    return m


def _scores(c: np.ndarray, q: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can leave 2**53, in longs below 2**62, else in Python's integers. Raises if a score of those in `other` is no long."""
    with np.errstate(over="ignore"):
        reach = np.abs(c).max(1, initial=0) * float(np.abs(q).max(initial=0)) * c.shape[1]
    small = reach < 2**53
    if small.all():
        return (c @ q.T).astype(np.int64)
    out = np.zeros((len(c), len(q)), np.int64)
    out[small] = c[small] @ q.T
    long = ~small & (reach < 2**62)
    if long.any():
        out[long] = c[long].astype(np.int64) @ q.T.astype(np.int64)
    wide = ~small & ~long
    if wide.any():
        exact = lambda m: np.array([[int(x) for x in r] for r in m], object)
        s = exact(c[wide]) @ exact(q).T
        s[~other[wide]] = 0
        if s.size and not (-(2**63) <= s.min() and s.max() < 2**63):
            raise OverflowError("a score leaves a 64-bit integer")
        out[wide] = s.astype(np.int64)
    return out


def _chunks(vectors: DataFrame, scale: float, dim: int) -> DataFrame:
    """Packed candidates: ids, m (doubles), largest norm."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                part = b.iloc[at : at + CHUNK]
                m = _integers(part["v"].tolist(), scale, dim)
                with np.errstate(over="ignore"):
                    norm = float(np.sqrt((m**2).sum(1)).max(initial=0))
                yield pd.DataFrame({"ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()], "norm": [norm]})

    return vectors.mapInPandas(work, "ids binary, m binary, norm double")


def _bunches(batches: Iterator[pd.DataFrame], dim: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    held, size = [], 0
    for b in batches:
        for ids, m in zip(b["ids"], b["m"]):
            held.append((np.frombuffer(ids, np.int64), np.frombuffer(m, np.float64).reshape(-1, dim)))
            size += len(m)
            if size >= BUNCH_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


class _Wave:
    """The queries of a wave and the range [low, last] of scores that holds each one's k-th. 64-bit differences are taken modulo 2**64."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, longest: float, k: int) -> None:
        self.ids, self.m, self.bins, self.block = ids, m, BINS, QUERY_BLOCK
        with np.errstate(over="ignore"):
            bound = np.sqrt((m**2).sum(1)) * longest * (1 + 1e-9) + 2
        near = bound < 2.0**62
        reach = np.where(near, bound, 0).astype(np.int64)
        self.low = np.where(near, -reach, np.iinfo(np.int64).min)
        self.last = np.where(near, reach, np.iinfo(np.int64).max)
        self.need = np.full(len(ids), k, np.int64)
        self.open = np.ones(len(ids), bool)

    def width(self) -> np.ndarray:
        return (self.last - self.low).view(np.uint64) // np.uint64(self.bins) + np.uint64(1)

    def narrow(self, query_id: np.ndarray, bin_: np.ndarray, above: np.ndarray) -> None:
        """Take the k-th score's bin of each open query that has one; a query without has fewer than k candidates, all of which it keeps."""
        at, width = np.searchsorted(self.ids, query_id), self.width()
        found = np.zeros(len(self.ids), bool)
        found[at] = True
        low = self.low[at] + (bin_.astype(np.uint64) * width[at]).view(np.int64)
        room = np.minimum((self.last[at] - low).view(np.uint64), width[at] - np.uint64(1))
        self.low[at], self.last[at] = low, low + room.view(np.int64)
        self.need[at] -= above
        self.open &= found & (self.low != self.last)

    def blocks(self, mask: np.ndarray) -> Iterator[np.ndarray]:
        at = np.flatnonzero(mask)
        for i in range(0, len(at), self.block):
            yield at[i : i + self.block]


def _histogram(held, dim: int, k: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w: _Wave = held.value
        width = w.width()
        for bunch in _bunches(batches, dim):
            for at in w.blocks(w.open):
                low, last, wide, q = w.low[at][None, :], w.last[at][None, :], width[at][None, :], w.m[at]
                h = np.zeros((len(at), w.bins), np.int64)
                for ids, m in bunch:
                    other = ids[:, None] != w.ids[at][None, :]
                    s = _scores(m, q, other)
                    ok = (s >= low) & (s <= last) & other
                    place = ((s - low).view(np.uint64) // wide).astype(np.int64) + np.arange(len(at))[None, :] * w.bins
                    h += np.bincount(place[ok], minlength=h.size).reshape(h.shape)
                above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1] - h
                i, j = np.nonzero((h > 0) & (above < w.need[at][:, None]))
                yield pd.DataFrame({"query_id": w.ids[at][i], "bin": j.astype(np.int32), "n": h[i, j]})

    return work


def _keep(held, dim: int, k: int):
    def trim(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((v, -s.astype(np.float64), q)) if not len(s) or np.abs(s).max() < 2**53 else np.array(sorted(range(len(s)), key=lambda i: (q[i], -int(s[i]), v[i])), int)
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q, side="left")
        stay = np.arange(len(q)) - first < k
        return q[stay], v[stay], s[stay]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w: _Wave = held.value
        for bunch in _bunches(batches, dim):
            for at in w.blocks(np.ones(len(w.ids), bool)):
                best = (np.zeros(0, np.int64),) * 3
                for ids, m in bunch:
                    other = ids[:, None] != w.ids[at][None, :]
                    s = _scores(m, w.m[at], other)
                    i, j = np.nonzero((s >= w.low[at][None, :]) & other)
                    best = trim(*(np.concatenate(x) for x in zip(best, (w.ids[at][j], ids[i], s[i, j]))))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), best)))

    return work


def _search_wave(chunks: DataFrame, wave: _Wave, dim: int, k: int) -> DataFrame:
    sc = chunks.sparkSession.sparkContext
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
    while wave.open.any():
        need = k if (wave.need == k).all() else None
        bins = chunks.mapInPandas(_histogram(sc.broadcast(wave), dim, k), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        if need is None:
            rest = chunks.sparkSession.createDataFrame(pd.DataFrame({"query_id": wave.ids[wave.open], "need": wave.need[wave.open]}))
            bins = bins.join(F.broadcast(rest), "query_id")  # WAVE_QUERIES rows at most
        else:
            bins = bins.withColumn("need", F.lit(need).cast("long"))
        at = bins.withColumn("upto", upto).where(F.col("upto") >= F.col("need")).groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("hit"))
        got = at.select("query_id", "hit.bin", "hit.above").toArrow().to_pandas()  # one row a query of the wave
        wave.narrow(*(got[c].to_numpy(np.int64) for c in ("query_id", "bin", "above")))
    near = chunks.mapInPandas(_keep(sc.broadcast(wave), dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, wave_queries: int = WAVE_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores among all rows with another id, ties to the smaller id.

    vectors needs vec_id and embedding; `queries` says which rows are queries. Rows with a null id or that are not `usable`
    take no part; shorter vectors count as padded with zeros; of rows with one vec_id one is the query, and each is a
    candidate of other ids; a query with fewer than k candidates gets them all; an empty table gives no rows. A score that
    no long holds is an OverflowError.
    """
    v = vectors.where(queries | ~queries).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asked"))
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    dim, n_asked = v.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if("asked")).first()
    spark = vectors.sparkSession
    if not n_asked or not dim:
        return spark.createDataFrame([], SCHEMA)
    chunks = materialize(_chunks(v.select("vec_id", "v"), scale, dim), "chunks")
    longest = chunks.agg(F.max("norm")).first()[0]
    n_waves = -(-n_asked // max(min(QUERY_BLOCK, wave_queries), min(wave_queries, BROADCAST_BYTES // (8 * dim))))
    one = v.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("wave", F.pmod(F.xxhash64("vec_id"), F.lit(n_waves)))
    asked = materialize(one, "queries") if n_waves > 1 else one
    out = None
    for i in range(n_waves):
        got = asked.where(F.col("wave") == i).select("vec_id", "v").toArrow().to_pandas().sort_values("vec_id")
        if len(got):
            found = _search_wave(chunks, _Wave(got["vec_id"].to_numpy(np.int64), _integers(got["v"].tolist(), scale, dim), longest, k), dim, k)
            found = materialize(found, "wave") if n_waves > 1 else found
            out = found if out is None else out.unionByName(found)
    return out
