"""Toxicity classifier with counterfactual regularisation.

A ridge-penalised logistic regression over the distinct words of a text and their first 4 and 5
letters. In the labelled texts' sentences, identity terms are swapped for others of their group; the squared change
of the score's logit, weighed by the sentences in which a swap can be made, is added to the loss, so a neutral mention
of a group doesn't move the score. It is fitted on a bounded sample of labelled rows: at most SAMPLE_TOXIC and
SAMPLE_OTHER, the first by a hash of doc_id. Their features are counted and chosen on the executors; the driver
gets FEATURES bits a row. Only rows whose crc32(doc_id) mod 3 is not 1 are learnt from. Inputs of a score are the
text's words alone.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import materialize, text_batches

SAMPLE_TOXIC, SAMPLE_OTHER = 4000, 8000
FEATURES, LEAST_DOCS, RIDGE, SWAP = 512, 3, 0.1, 1.0
#: Toxic rows weigh as much as the others together, but at most this much each.
BALANCE = 8.0
THRESHOLD = 0.7
PREFIXES = (4, 5)
#: Groups of identity terms, whose members are swapped for each other.
IDENTITY_GROUPS = (
    "women men girls boys",
    "christians muslims jews hindus buddhists atheists",
    "black white asian latino arab indigenous",
    "gay lesbian straight bisexual transgender queer",
    "immigrants refugees foreigners natives citizens",
    "disabled blind deaf elderly young",
    "frauen männer mädchen jungen",
    "christen muslime juden hindus atheisten",
    "ausländer flüchtlinge einwanderer einheimische",
    "femmes hommes filles garçons",
    "chrétiens musulmans juifs athées",
    "étrangers réfugiés immigrés",
    "mujeres hombres chicas chicos",
    "cristianos musulmanes judíos ateos",
    "extranjeros refugiados inmigrantes",
)
_GROUP = {t: g.split() for g in IDENTITY_GROUPS for t in g.split()}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features_of(word: str) -> set[int]:
    return {zlib.crc32(word.encode("utf-8", "surrogatepass"))} | {zlib.crc32(f"{word[:n]}*".encode("utf-8", "surrogatepass")) for n in PREFIXES if len(word) >= n}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Weights by feature; score is the logistic of their sum over a text's distinct features."""

    weights: dict[int, float]
    bias: float

    def scorer(self, most_words: int = 100_000):
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for w in words_of(text or ""):
                f = known.get(w)
                if f is None:
                    if len(known) >= most_words:
                        known.clear()
                    f = known[w] = tuple(x for x in features_of(w) if x in self.weights)
                if f:
                    hit.update(f)
            z = self.bias + sum(self.weights[x] for x in sorted(hit))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def strength(total: np.ndarray, pos: np.ndarray, n: int, n_pos: int) -> np.ndarray:
    """How far a feature's shares among the toxic and the other texts lie apart, in standard errors; 0 for rare ones and those of all texts."""
    p, q, rate = pos / n_pos, (total - pos) / (n - n_pos), total / n
    z = np.abs(p - q) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n_pos + 1 / (n - n_pos)))
    return np.where((total < LEAST_DOCS) | (total == n), 0.0, z)


def strength_column(total: Column, pos: Column, n: int, n_pos: int) -> Column:
    """strength over columns of counts, to the same doubles."""
    p, q, rate = pos / F.lit(float(n_pos)), (total - pos) / F.lit(float(n - n_pos)), total / F.lit(float(n))
    z = F.abs(p - q) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * F.lit(1 / n_pos + 1 / (n - n_pos)))
    return F.when((total < LEAST_DOCS) | (total == n), 0.0).otherwise(z)


def solve(x: np.ndarray, y: np.ndarray, chosen: np.ndarray, swaps: list[tuple[str, str, int]]) -> Model:
    """Newton's method on log loss + ridge + counterfactual penalty; x: a row a text, a column of 0 and 1 for each feature of `chosen`."""
    n, n_pos = len(y), float(y.sum())
    bias = float(np.log((n_pos + 0.5) / (n - n_pos + 0.5)))
    x = np.concatenate((x, np.ones((n, 1))), axis=1).astype(np.float32)
    swap = np.zeros((len(chosen) + 1, len(chosen) + 1))
    place = {int(f): i for i, f in enumerate(chosen)}
    for a, b, count in swaps:
        d = np.zeros(len(chosen) + 1)
        for f in features_of(a) ^ features_of(b):
            if f in place:
                d[place[f]] = 1 if f in features_of(b) else -1
        swap += count * np.outer(d, d)
    ridge = np.full(len(chosen) + 1, RIDGE)
    ridge[-1] = 1e-6
    weight = np.where(y > 0, np.clip((n - n_pos) / n_pos, 1, BALANCE), 1.0)
    w = np.zeros(len(chosen) + 1)
    w[-1] = bias
    for _ in range(25):
        m = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (m - y)) + ridge * w + SWAP * swap @ w
        h = (x * (weight * np.maximum(m * (1 - m), 1e-6))[:, None].astype(np.float32)).T @ x + np.diag(ridge) + SWAP * swap
        step = np.linalg.solve(h, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return Model({int(c): float(v) for c, v in zip(chosen, w)}, float(w[-1]))


def prior(n: int, n_pos: int) -> Model:
    """Without labels of both kinds: every text scores by their counts."""
    return Model({}, float(np.log((n_pos + 0.5) / (n - n_pos + 0.5))))


def train(features: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[str, str, int]]) -> Model:
    """The model of texts in memory; features: distinct feature ids per text."""
    y = np.asarray(labels, np.float64)
    n, n_pos = len(y), int(y.sum())
    if not 0 < n_pos < n:
        return prior(n, n_pos)
    ids, code = np.unique(np.concatenate(features), return_inverse=True)
    doc = np.repeat(np.arange(n), [len(f) for f in features])
    z = strength(np.bincount(code, minlength=len(ids)), np.bincount(code, weights=y[doc], minlength=len(ids)), n, n_pos)
    best = np.lexsort((ids, -z))[:FEATURES]
    chosen = np.sort(ids[best[z[best] > 0]])
    return solve(np.array([np.isin(chosen, f) for f in features]).reshape(n, len(chosen)), y, chosen, swaps)


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, toxic, distinct features, and the swaps that can be made, once a sentence."""
    for b in batches:
        out = []
        for doc_id, text, toxic in zip(b["doc_id"], b["text"], b["toxic"]):
            words = words_of(text or "")
            found: set[int] = set().union(*map(features_of, words)) if words else set()
            swaps: list[str] = []
            if not words.isdisjoint(_GROUP):
                for sentence in _SENTENCE.split(text.lower()):
                    for w in sorted(set(_WORD.findall(sentence)) & _GROUP.keys()):
                        swaps += [f"{w} {other}" for other in _GROUP[w] if other != w]
            out.append((doc_id, toxic, np.array(sorted(found), np.uint32).tobytes(), swaps))
        yield pd.DataFrame(out, columns=["doc_id", "toxic", "found", "swaps"])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts = [np.frombuffer(f, np.uint32) for f in b["found"]]
        ids, code = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_inverse=True)
        toxic = np.repeat(b["toxic"].to_numpy(np.float64), [len(x) for x in parts])
        pos = np.bincount(code, weights=toxic, minlength=len(ids)).astype(np.int64)
        yield pd.DataFrame({"feature": ids.astype(np.int64), "total": np.bincount(code, minlength=len(ids)), "pos": pos})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, toxic (0 or 1; null: not a label; of several, the largest). docs: doc_id, text.

    A null text is empty; of rows of one doc_id the smallest text counts; a label without a document, or with a null
    doc_id, teaches nothing; without labels of both kinds every text scores alike.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_OTHER))
    rows = text_batches(docs).select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # SAMPLE_TOXIC + SAMPLE_OTHER ids at most
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    seen = materialize(once.mapInPandas(_found, "doc_id long, toxic int, found binary, swaps array<string>"), "features")
    n, n_pos = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_pos < n:
        return prior(n, n_pos)
    counts = seen.select("found", "toxic").mapInPandas(_counted, "feature long, total long, pos long").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("pos").alias("pos"))
    best = counts.where(F.col("total") >= LEAST_DOCS).select("feature", strength_column(F.col("total"), F.col("pos"), n, n_pos).alias("z")).where("z > 0").orderBy(F.desc("z"), "feature").limit(FEATURES)
    chosen = np.sort(np.array([r.feature for r in best.collect()], np.uint32))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [np.packbits(np.isin(chosen, np.frombuffer(f, np.uint32))).tobytes() for f in b["found"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "bits": rows})

    got = seen.select("doc_id", "toxic", "found").mapInPandas(bits, "doc_id long, toxic int, bits binary").toArrow().to_pandas().sort_values("doc_id")
    swaps = seen.select(F.explode("swaps").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).orderBy("pair").collect()  # pairs of one identity group
    size = -(-len(chosen) // 8)
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), size), axis=1)[:, : len(chosen)]
    return solve(x, got["toxic"].to_numpy(np.float64), chosen, [(*r.pair.split(), r.n) for r in swaps])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. A null or empty text scores by the bias alone; repeated rows and null ids are scored as they come."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = held.value.scorer()
        for b in batches:
            s = np.array([one(t) for t in b["text"]], np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    narrow = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that are predicted toxic; columns and order of columns stay.

    A null or empty text scores by the bias alone, so it stays unless most labels are toxic; rows without a doc_id and
    repeated rows are judged one by one; an empty table stays empty.
    """
    held = text_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = held.value.scorer()
        for s in batches:
            yield pd.Series([one(t) >= THRESHOLD for t in s], dtype=bool)

    return docs.where(~rejected(F.col("text").cast("string")))
