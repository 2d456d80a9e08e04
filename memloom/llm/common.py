"""What several operators share: stage tables, word hashing, Bloom filters, components.

Stage tables are Parquet folders under spark.checkpoint.dir, which every executor
can read, so a lost executor never takes a stage's result with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.stage import materialize, stage_dir  # noqa: F401  (operators take them from here)

#: Rows of an Arrow batch of whole texts. A batch is held a few times over, on both sides of the pipe to Python.
TEXT_ROWS = 1000


def text_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches held to TEXT_ROWS rows at most, since these rows carry whole texts."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, str(TEXT_ROWS))
    return docs


def in_written_order(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns of docs; if docs is a Parquet table just read, its rows come back in the order they were written.

    Spark plans files by size and not by name, so the rows are dealt to ranges of (part number, file, row) and sorted
    there: partition ids follow the order. Any other docs keep the order of their partitions.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return docs.select(*columns)
    file = F.col("_metadata.file_name")
    part = F.regexp_extract(file, r"^part-(\d{1,18})", 1)
    at = F.struct(F.when(part != "", part.cast("long")).alias("part"), file.alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = docs.select(*columns, at.alias("__at"))
    return placed.repartitionByRange("__at").sortWithinPartitions("__at").select(*columns)


# ---------------------------------------------------------------- word hashing

#: Odd multipliers of the polynomial hashes and of the final mixing step (splitmix64).
_BASE = 0x9E3779B97F4A7C15 | 1
_WIN = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_CHUNK = 1 << 20
_LONG_WORD = 64


class _Powers:
    """Powers of _BASE and of its inverse mod 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * _CHUNK)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_POWERS = _Powers()


def mix64(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(texts: list[str | None], most: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` characters; a longer text stands alone."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def hash_words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and each text's first word's index (one more at the end).

    lower: A-Z are lower-cased first. A null text has no words. Words over 64 bytes are hashed by BLAKE2b.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    joined = b" ".join(raw) + b" "
    b = np.frombuffer(joined, np.uint8)
    if lower:
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
    gap = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate(([True], gap)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS.upto(len(b) + 1)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
    h = (prefix[end] - prefix[start]) * down[start]
    for i in np.flatnonzero(end - start > _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    return mix64(h), first


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive words; the last k-1 places hold nothing of use."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    h = np.full(n - k + 1, int(seed) & _MASK, np.uint64)
    for j in range(k):
        h = h * np.uint64(_WIN) + words[j : n - k + 1 + j]
    return mix64(h)


# ---------------------------------------------------------------- Bloom filters


class Bloom:
    """A Bloom filter over 64-bit hashes of at most `2**log_bits` bits, whatever the input's size.

    Fuller filters let more rows through to an exact join behind them and never lose one.
    """

    LEAST, MOST, PROBES = 16, 27, 3  # 16 MB at most

    def __init__(self, words: np.ndarray, log_bits: int) -> None:
        self.words, self.log_bits = words, log_bits

    @classmethod
    def of(cls, df: DataFrame, hash_col: str, expected: int) -> Bloom:
        """Build it on the executors; at most 2**(MOST-6) words of 64 bits reach the driver."""
        log_bits = min(cls.MOST, max(cls.LEAST, int(np.ceil(np.log2(max(1, expected) * 12)))))
        at = F.explode(F.array(*[F.shiftrightunsigned(F.xxhash64(F.col(hash_col), F.lit(i)), 64 - log_bits) for i in range(cls.PROBES)]))
        got = (
            df.select(at.alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"))
            .toArrow()
        )
        words = np.zeros(1 << max(0, log_bits - 6), np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return cls(words, log_bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these signed 64-bit values may be in it."""
        ok = np.ones(len(hashes), bool)
        for i in range(self.PROBES):
            bit = xxhash64_long_int(hashes, i) >> np.uint64(64 - self.log_bits)
            ok &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
        return ok


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxhash64_long_int(values: np.ndarray, second: int) -> np.ndarray:
    """What Spark's xxhash64(bigint, int) gives, as unsigned values: XXH64 of 8 bytes with seed 42, then of 4 bytes with that as seed."""
    with np.errstate(over="ignore"):
        v = values.view(np.uint64) if values.dtype != np.uint64 else values
        h = np.uint64(42) + _P5 + np.uint64(8)
        h = h ^ (_rotl(v * _P2, 31) * _P1)
        h = _avalanche(_rotl(h, 27) * _P1 + _P4)
        h = h + _P5 + np.uint64(4)
        h = h ^ (np.uint64(second) * _P1)
        return _avalanche(_rotl(h, 23) * _P2 + _P3)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links by alternating large and small stars.

    Returns (node, component): every node that has a link, with the smallest node it reaches.
    Each round keeps at most as many links as before and is written to the shared folder.
    """
    u, v = F.col("u"), F.col("v")
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(u != v).distinct(), "links"
    )
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(v, u))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(u, F.col("m").alias("v")).union(joined.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")))
        e = materialize(small.where(u != v).distinct(), "links")
        was, mark = mark, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == (was and tuple(was)):
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    star = e.groupBy("u").agg(F.min("v").alias("component")).select(u.alias("node"), "component")
    roots = e.select(v.alias("node"), v.alias("component")).distinct()
    return star.unionByName(roots)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
