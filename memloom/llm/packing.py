"""Harmonic packing of token sequences into fixed-length training sequences.

A document's tokens beyond whole sequences, its remainder, are of class k if their number is in (C/(k+1), C/k],
C the capacity, and a bin of class k takes exactly k remainders, uncut. What is then left of the bin, less than
C/(k+1), is filled from the remainders of the next documents, which may be cut: so a full bin has no
padding, and a remainder is cut only where it tops up a bin. Each worker fills its own bins. Lengths fall into
no more than 2 * sqrt(C) classes, each with one open bin, so a worker's memory is bounded by the
capacity. What is open at the end of a worker's input is joined, cut at the capacity, and closed
with sequences whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import text_batches

CAPACITY = 1024
#: Texts of these characters alone are cut into words alike by both libraries; all others go through `tokenizers`.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ɏ]*\\Z")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
#: Token ids of an Arrow batch of pieces, about.
IDS_OUT = 1 << 20


def byte_bpe(json_path: str | None = None, ranks_path: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids as `tokenizers` gives them for the public byte-level BPE with add_special_tokens=False.

    The same vocabulary comes in two formats. The faster library encodes plain texts without a special
    string (ids are equal, which a test checks), `tokenizers` all others.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    with open(json_path, encoding="utf-8") as f:
        special = tuple(t["content"] for t in json.load(f).get("added_tokens", ()))

    @cache
    def full() -> Tokenizer:  # read only if a text needs it
        return Tokenizer.from_file(json_path)

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if _PLAIN.match(text) and not any(t in text for t in special):
            return fast.encode_ordinary(text)
        return full().encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's whole sequences, then of its remainder."""
    for start in range(0, n, capacity):
        yield start, min(capacity, n - start)


class HarmonicBins:
    """Open bins of one worker. A piece is (document, start, ids); full bins come out of `take` as (piece, sequence id, offset)."""

    def __init__(self, capacity: int, first_id: int) -> None:
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.waiting: list[list[tuple]] = []  # bins with all their remainders that still need topping up

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((p, self.next_id, at))
            at += len(p[2])
        self.next_id += 1
        return out

    def take(self, doc: tuple, ids: np.ndarray) -> list[tuple]:
        """All tokens of a document: whole sequences, then of the remainder what tops up waiting bins, then the rest to its class."""
        out: list[tuple] = []
        for start, length in cut(len(ids), self.capacity):
            at, end = start, start + length
            while length < self.capacity and self.waiting and at < end:
                bin_ = self.waiting[-1]
                n = min(self.capacity - sum(len(p[2]) for p in bin_), end - at)
                bin_.append((doc, at, ids[at : at + n].copy()))
                at += n
                if sum(len(p[2]) for p in bin_) == self.capacity:
                    out += self._close(self.waiting.pop())
            if at < end:
                out += self._put((doc, at, ids[at:end].copy()))  # an open piece doesn't hold its document
        return out

    def _put(self, piece: tuple) -> list[tuple]:
        k = self.capacity // len(piece[2])
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) < k:
            return []
        del self.open[k]
        if sum(len(p[2]) for p in bin_) == self.capacity:
            return self._close(bin_)
        self.waiting.append(bin_)
        return []

    def rest(self) -> list[tuple]:
        """Close what is open: its pieces joined and cut at the capacity, the last of them at powers of two."""
        left = [p for bin_ in [*self.waiting, *(self.open[k] for k in sorted(self.open))] for p in bin_]
        self.waiting, self.open = [], {}
        out, size, total = [], self.capacity, sum(len(p[2]) for p in left)
        held: list[tuple] = []
        room = 0
        for doc, start, ids in left:
            at = 0
            while at < len(ids):
                if not room:
                    while size > total:
                        size >>= 1
                    room = size
                n = min(room, len(ids) - at)
                held.append((doc, start + at, ids[at : at + n]))
                at, room, total = at + n, room - n, total - n
                if not room:
                    out += self._close(held)
                    held = []
        return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, make_encoder: Callable[[], Callable[[str], list[int]]] = byte_bpe) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids are the piece's token ids: a training sequence is the ids of its pieces by offset. docs needs
    doc_id and text; other columns are ignored. A null text is empty, and so only
    end_id is packed; repeated rows are packed as often as they occur; a null doc_id stays null;
    an empty table gives no rows. sequence_id is unique over workers: the partition's number
    times 2**40, plus a count. There is no shuffle, and a re-run task makes the same rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 40)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            *longs, ids = zip(*((doc[0], s, len(i), zlib.crc32(i.tobytes()), doc[1], q, o, i) for (doc, s, i), q, o in rows))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), tokens], names=[*names, "ids"])

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for closed in bins.take((doc_id, len(ids)), ids):
                    rows.append(closed)
                    held += len(closed[0][2])
                    if held >= IDS_OUT:
                        yield batch_of(rows)
                        rows, held = [], 0
        rows += bins.rest()
        if rows:
            yield batch_of(rows)

    narrow = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(work, SCHEMA)


def summary(pieces: DataFrame) -> DataFrame:
    """Pieces with the digest of their ids in place of the ids."""
    return pieces.drop("ids")
