"""Removal of repeated passages: winnowed anchors as seeds, extended both ways.

A window is WINDOW consecutive words; its anchor is the first of its smallest ANCHOR-word
hashes, so equal windows have equal anchors at equal places. The windows around one anchor
that all choose it are a seed extended both ways as far as the anchor reaches: a segment.
Documents are joined on segments, not on windows, so a shared passage costs a row for every
few words:

1. anchors and segments of all texts are aggregated to the smallest and largest doc_id;
2. a segment that starts in a smaller document goes as a whole;
3. where one anchor has several segments (a passage's edges, an edit), the segments' first
   documents are compared window by window. A later copy of a segment adds no window there
   that its first copy doesn't have.

The removed spans of a document overlap into maximal repeats of WINDOW words or more.
An anchor that a sample of the documents shows to be frequent is dealt to SALTS tasks by segment.
Bloom filters of bounded size only thin out what is joined; joins decide. Keys of joins
are 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import Bloom, hash_words, materialize, mix64, text_batches, text_slices, window_hashes

WINDOW, ANCHOR = 13, 5
#: An anchor of more than HOT_SHARE of about HOT_SAMPLE sampled documents is hot: its rows go to SALTS tasks. At most HOT_MOST are, the commonest.
#: Only how rows are dealt to tasks depends on the sample; results don't.
HOT_SAMPLE, HOT_SHARE, HOT_MOST, SALTS = 10_000, 0.002, 4096, 64
_WORD = re.compile("[^\x20\x09-\x0d]+")
_U = np.uint64


def segments(texts: list[str | None], window: int = WINDOW, k: int = ANCHOR) -> dict[str, np.ndarray]:
    """All segments of the texts: doc (index), start (word), n (windows), anchor, seg, and hashes of all windows with `at`, each segment's first."""
    words, first = hash_words(texts)
    n_words = np.diff(first)
    grams, wide = window_hashes(words, k), window_hashes(words, window, seed=1)
    doc_of = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(words)) - np.repeat(first[:-1], n_words)
    if not len(wide):
        none = np.zeros(0, np.int64)
        return {"doc": none, "start": none, "n": none, "anchor": none, "seg": none, "windows": none, "at": none}
    ok = place[: len(wide)] + window <= n_words[doc_of[: len(wide)]]
    reach = window - k + 1
    chosen = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(1) + np.arange(len(wide))
    live = np.flatnonzero(ok)
    new = np.ones(len(live), bool)
    new[1:] = (chosen[live[1:]] != chosen[live[:-1]]) | (doc_of[live[1:]] != doc_of[live[:-1]])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(live)))
    s = live[at]
    # the hash of a segment's words from those of its windows at both ends and its shape
    shape = n * 64 + (chosen[s] - s)
    seg = mix64(mix64(wide[s] + _U(0x9E3779B97F4A7C15)) ^ (wide[s + n - 1] * _U(0xD6E8FEB86659FD93)) ^ shape.astype(np.uint64))
    return {
        "doc": doc_of[s], "start": place[s], "n": n, "anchor": grams[chosen[s]].view(np.int64),
        "seg": seg.view(np.int64), "windows": wide[live].view(np.int64), "at": at,
    }


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, dict[str, np.ndarray]]]:
    for b in batches:
        b = b[b["doc_id"].notna()]
        texts = b["text"].tolist()
        for i, j in text_slices(texts, 1 << 21):
            yield b.iloc[i:j], segments(texts[i:j])


def _pair_key(seg: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix64(seg.view(np.uint64) ^ mix64(doc.view(np.uint64))).view(np.int64)


def hot_anchors(docs: DataFrame) -> np.ndarray:
    n = docs.count()
    sample = docs.sample(min(1.0, HOT_SAMPLE / max(n, 1)), seed=13)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, s in _batches(batches):
            pairs = np.unique(np.stack((s["anchor"], s["doc"])), axis=1)
            anchor, docs_of = np.unique(pairs[0], return_counts=True)
            yield pd.DataFrame({"anchor": anchor[docs_of > 1], "n": docs_of[docs_of > 1]})

    counts = sample.select("doc_id", "text").mapInPandas(work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    least = max(2.0, HOT_SHARE * min(n, HOT_SAMPLE))
    return np.sort(np.array([r.anchor for r in counts.where(F.col("n") > least).orderBy(F.desc("n"), "anchor").limit(HOT_MOST).collect()], np.int64))


def repeated_segments(docs: DataFrame) -> DataFrame:
    """(anchor, seg, lo, shared, several): segments of several documents, and those whose anchor has several segments, or is hot."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, s in _batches(batches):
            doc = b["doc_id"].to_numpy(np.int64)[s["doc"]]
            order = np.lexsort((doc, s["seg"]))
            seg, doc = s["seg"][order], doc[order]
            head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])[: len(seg)])
            anchor = s["anchor"][order][head]
            salt = np.where(np.isin(anchor, hot.value), 1 + seg[head] % SALTS, 0).astype(np.int32)
            yield pd.DataFrame({"anchor": anchor, "salt": salt, "seg": seg[head], "lo": doc[head], "hi": doc[np.append(head[1:], len(seg))[: len(head)] - 1]})

    rows = docs.select("doc_id", "text").mapInPandas(work, "anchor long, salt int, seg long, lo long, hi long")
    each = rows.repartition("anchor", "salt").groupBy("anchor", "salt", "seg").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    several = (F.count("*").over(Window.partitionBy("anchor", "salt")) > 1) | (F.col("salt") > 0)
    shared = F.col("lo") < F.col("hi")
    return each.withColumn("several", several).withColumn("shared", shared).where("several OR shared").drop("hi", "salt")


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, n_words): words that also stand in an earlier document, as spans that may overlap."""
    sc = docs.sparkSession.sparkContext
    known = materialize(repeated_segments(docs), "segments")
    n_shared, n_several = known.agg(F.count_if("shared"), F.count_if("several")).first()
    pair = F.pandas_udf(lambda seg, doc: pd.Series(_pair_key(seg.to_numpy(np.int64), doc.to_numpy(np.int64))), "long")
    in_shared = sc.broadcast(Bloom.of(known.where("shared"), "seg", n_shared))
    in_first = sc.broadcast(Bloom.of(known.where("several").select(pair("seg", "lo").alias("p")), "p", n_several))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = "key long, anchor long, doc_id long, text_key long, start int, n_words int"

    def rows(b: pd.DataFrame, s: dict[str, np.ndarray], keep: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        doc = s["doc"][keep]
        return pd.DataFrame({
            "key": key, "anchor": s["anchor"][keep], "doc_id": b["doc_id"].to_numpy(np.int64)[doc],
            "text_key": b["text_key"].to_numpy(np.int64)[doc], "start": start.astype(np.int32), "n_words": (n + WINDOW - 1).astype(np.int32),
        })

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, s in _batches(batches):
            keep = np.flatnonzero(in_shared.value.has(s["seg"]))
            yield rows(b, s, keep, s["seg"][keep], s["start"][keep], s["n"][keep])

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, s in _batches(batches):
            doc = b["doc_id"].to_numpy(np.int64)[s["doc"]]
            hit = np.flatnonzero(in_first.value.has(_pair_key(s["seg"], doc)))
            keep = np.repeat(hit, s["n"][hit])
            step = np.arange(len(keep)) - np.repeat(np.cumsum(s["n"][hit]) - s["n"][hit], s["n"][hit])
            yield rows(b, s, keep, s["windows"][s["at"][keep] + step], s["start"][keep] + step, np.ones(len(keep), np.int64))

    span = ["doc_id", "text_key", "start", "n_words"]
    later = texts.mapInPandas(whole, schema).join(known.where("shared").select(F.col("seg").alias("key"), "anchor", "lo"), ["key", "anchor"]).where("doc_id > lo").select(*span)
    windows = materialize(texts.mapInPandas(single, schema), "windows")
    firsts = windows.groupBy("key", "anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")
    edges = windows.join(firsts, ["key", "anchor"]).where("doc_id > lo").select(*span)
    return later.unionByName(edges)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    docs needs doc_id and text; other columns are ignored. A null or empty text has no words; a null
    doc_id comes after no document, so its words stay and remove nothing elsewhere; rows of one doc_id
    don't remove from each other; an empty table gives no rows.
    """
    docs = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = removed_spans(docs).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    joined = docs.withColumn("text_key", F.xxhash64("text")).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", F.col("spans.start").alias("start"), F.col("spans.n_words").alias("length"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, start, length in zip(b["text"], b["start"], b["length"]):
                words = _WORD.findall(text)
                gone = 0
                if start is not None:
                    turn = np.zeros(len(words) + 1, np.int64)
                    np.add.at(turn, start, 1)
                    np.add.at(turn, np.asarray(start) + np.asarray(length), -1)
                    left = np.cumsum(turn[:-1]) == 0
                    gone = len(words) - int(left.sum())
                    words_left = [words[i] for i in np.flatnonzero(left)]
                n_words.append(len(words))
                n_removed.append(gone)
                kept.append(" ".join(words_left if gone else words))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": n_words, "n_removed": n_removed, "kept": kept})

    return joined.mapInPandas(work, "doc_id long, n_words long, n_removed long, kept string")


def summary(left: DataFrame) -> DataFrame:
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
