import random

import numpy as np

from memloom.llm import minhash_dedup
from memloom.llm.common import Bloom, xxhash64_long_int

from .helpers import WORDS, components, docs_frame, words


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = WORDS.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, links)


def edited(base, n, seed):
    r = random.Random(seed)
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rows = [(i, " ".join(words(150, i))) for i in range(60)]
    base = words(200, 1000)
    rows += [(100 + i, edited(base, i % 9, i)) for i in range(80)]  # one large group of edited copies
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "ONE  two"), (405, "one two three"), (406, "é" * 3000), (407, "word " * 3000)]
    rows += [(500 + i, edited(words(60, 2000 + i // 2), i % 2, i)) for i in range(30)]
    return rows


def test_equals_brute_force_in_whole_clusters_and_in_buckets(spark, monkeypatch):
    rows = corpus()
    df = docs_frame(spark, rows + [(None, rows[7][1]), (7, rows[7][1])])
    for cluster in (512, 16):
        monkeypatch.setattr(minhash_dedup, "CLUSTER", cluster)
        for percent in (80, 85):
            sets, want = brute(rows, percent)
            got = minhash_dedup.deduplicate(df, percent).collect()
            assert len(got) == len(rows) + 2
            for r in got:
                if r.doc_id is None:
                    assert r.component_id is None and r.kept
                else:
                    assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r.doc_id
    assert minhash_dedup.deduplicate(df.limit(0)).collect() == []


def test_keep_one(spark):
    rows = corpus()
    df = docs_frame(spark, rows + [(None, rows[7][1]), (7, rows[7][1])])
    _, want = brute(rows, 80)
    out = minhash_dedup.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted([(False, i) for i in want if want[i] == i] + [(True, 0)])


def test_pruning_bounds_and_signatures():
    for size, least in minhash_dedup.least_equal(85):
        assert 0 < least <= size
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 4000, np.uint64))
    b = np.concatenate((a[:3000], np.unique(r.integers(0, 1 << 63, 1000, np.uint64))))
    sig = minhash_dedup.minhash([a, np.unique(b)])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.13


def test_bloom_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    values = [0, 1, -1, 2**62, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for i in range(3):
        assert [r[0] for r in df.select(F.xxhash64("x", F.lit(i))).collect()] == xxhash64_long_int(np.array(values), i).view(np.int64).tolist()
    b = Bloom.of(df, "x", 5)
    assert b.has(np.array(values)).all() and b.has(np.arange(10, 2010)).mean() < 0.01


def test_keep_one_with_clashing_and_odd_names(spark):
    text = " ".join(words(60, 1))
    df = spark.createDataFrame([("x", 2, text, 1), ("y", 1, text, 2), ("z", None, text, 3)], "__gone string, doc_id long, text string, `a.b` int")
    got = minhash_dedup.keep_one(df)
    assert got.columns == df.columns and sorted(r[0] for r in got.collect()) == ["y", "z"]
    assert minhash_dedup.keep_one(df.limit(0)).collect() == []
