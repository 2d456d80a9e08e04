"""Secret scan: fixed patterns, and a likelihood ratio of two character Markov models.

One model describes random strings, the other ordinary identifiers. Both are trained
on labelled samples that a seeded generator writes (SAMPLES of each label, so the fit is
bounded and the same everywhere). A token of 16 characters or more is reported where its log-likelihood ratio,
in nats, is over LEAST_TOTAL and its mean per character over LEAST_MEAN. One without both a letter and a digit
needs LEAST_TOTAL_PLAIN and LEAST_MEAN_PLAIN, twice the total if its letters are of one case, since long
words of other languages look random to a model of English, and DISTINCT characters, since a rule of dashes does too.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import text_batches

KINDS = ("assign", "access", "hex", "markov")
SAMPLES = 6000
LEAST_TOTAL, LEAST_MEAN = 8.0, 0.2
LEAST_TOTAL_PLAIN, LEAST_MEAN_PLAIN, DISTINCT = 20.0, 0.4, 8
# re.ASCII: only A-Z and a-z have another case here
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # maximal runs, so the length can stand in the pattern
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_MIXED = re.compile(r"(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])")
SPAN_TYPE = "array<struct<kind:string,start:long,end:long,score:double>>"

_CHARS = string.ascii_letters + string.digits + "+/_-="
_CODE = np.full(128, len(_CHARS), np.int64)
_CODE[[ord(c) for c in _CHARS]] = np.arange(len(_CHARS))


def labelled_samples(n: int, seed: int) -> Iterator[tuple[str, int]]:
    """n random strings (1) and n ordinary identifiers (0)."""
    r = random.Random(seed)
    onset, nucleus, coda = "b c d f g h k l m n p r s t v w br ch cl cr dr fl gr pl pr qu sh sp st str th tr".split(), "a e i o u ea ou ai io".split(), ["", "", "n", "r", "s", "t", "l", "nt", "st", "ck", "ng", "tion"]
    words = "get set user name data file path id index list map key value count size time date node item page test config service request response handler build version server client table column query update delete create message session cache buffer stream parse format event state model view error result".split()
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef", "0123456789ABCDEF"]

    def word() -> str:
        return r.choice(words) if r.random() < 0.5 else "".join(r.choice(onset) + r.choice(nucleus) + r.choice(coda) for _ in range(r.randint(1, 4)))

    def number() -> str:
        return r.choice([str(r.randint(0, 99)), str(r.randint(1990, 2030)), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", str(r.randint(100, 10**9)), "0" * r.randint(2, 6) + str(r.randint(0, 999))])

    for _ in range(n):
        yield "".join(r.choices(r.choice(alphabets), k=r.randint(16, 48))), 1
        parts = [word() for _ in range(r.randint(2, 6))]
        for _ in range(r.randint(1, 3)):
            parts.insert(r.randint(0, len(parts)), number())
        style = r.randrange(5)
        if style == 0:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:])
        else:
            text = "_-/"[style % 3].join(parts)
        yield (text.upper() if r.random() < 0.15 else text), 0


class MarkovRatio:
    """Order-2 character models of both labels; `score` is the summed log ratio, random over ordinary."""

    def __init__(self, samples: Iterator[tuple[str, int]], alpha: float = 0.02) -> None:
        k = len(_CHARS) + 1
        counts = np.full((2, k, k, k), alpha)
        for text, label in samples:
            c = self._codes(text)
            np.add.at(counts[label], (c[:-2], c[1:-1], c[2:]), 1)
        pairs = counts.sum(3, keepdims=True)
        # what a pair of characters says little about leans on the single character before
        single = counts.sum(1)
        single = single / single.sum(2, keepdims=True)
        logp = np.log((counts + 8 * single[:, None]) / (pairs + 8))
        self.table = (logp[1] - logp[0]).astype(np.float32)

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
        c = _CODE[np.minimum(raw, 127)]
        return np.concatenate((np.full(2, len(_CHARS)), c))

    def score(self, text: str) -> float:
        c = self._codes(text)
        return float(self.table[c[:-2], c[1:-1], c[2:]].sum(dtype=np.float64))

    def is_secret(self, text: str, score: float) -> bool:
        if _MIXED.match(text):
            return score >= LEAST_TOTAL and score >= LEAST_MEAN * len(text)
        one_case = text.islower() or text[1:].islower() or text.isupper()
        return score >= LEAST_TOTAL_PLAIN * (1 + one_case) and score >= LEAST_MEAN_PLAIN * len(text) and len(set(text)) >= DISTINCT


def trained() -> MarkovRatio:
    return MarkovRatio(labelled_samples(SAMPLES, 20240101))


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def find(text: str, model: MarkovRatio) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, score) by start, then kind. Tokens that lie inside the patterns' spans are left to them; one that reaches beyond is scored as a whole."""
    out: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or ("api" in low and "key" in low):
        out += [("assign", m.start(), m.end(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    fixed = _merged((s, e) for _, s, e, _ in out)
    at = 0
    for m in _TOKEN.finditer(text):  # tokens come in order, as do the merged spans
        while at < len(fixed) and fixed[at][1] < m.end():
            at += 1
        if at < len(fixed) and fixed[at][0] <= m.start():
            continue
        if model.is_secret(m[0], score := model.score(m[0])):
            out.append(("markov", m.start(), m.end(), score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _map_texts(docs: DataFrame, names: list[str], per_text, schema: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield per_text(b)

    return docs.select(*names).mapInPandas(work, schema)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and `spans`, found in the whole text.

    A null or empty text has no spans; repeated rows and null ids are reported as they come;
    other columns are ignored; an empty table gives no rows. Offsets are code points, the end exclusive.
    """
    model = trained()

    def per_batch(b: pd.DataFrame) -> pd.DataFrame:
        spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t or "", model)] for t in b["text"]]
        return pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "spans": spans})

    narrow = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _map_texts(narrow, ["doc_id", "text"], per_batch, f"doc_id long, spans {SPAN_TYPE}")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by [SECRET:kind]; overlapping spans become one. n_chars follows where it is a column.

    No row is dropped; null texts stay null; all columns and their order are kept.
    """
    model = trained()

    def clean(text: str | None) -> str | None:
        if not text or not (found := find(text, model)):
            return text
        out, at, open_end = [], 0, -1
        for kind, s, e, _ in found:
            if s >= open_end:
                out += [text[at:s], f"[SECRET:{kind}]"]
            open_end = max(open_end, e)
            at = open_end
        return "".join([*out, text[at:]])

    clean_all = F.pandas_udf(lambda s: s.map(clean, na_action="ignore"), "string")
    out = text_batches(docs).withColumn("text", clean_all(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the fixed patterns' spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS if k != "markov"],
        F.sha2(_digest(F.filter("spans", lambda s: s.kind != "markov")), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
        count("markov").alias("n_markov"),
    )
