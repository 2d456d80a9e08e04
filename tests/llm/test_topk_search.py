import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.llm import topk_search


def brute(rows, k, every):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            scores = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in ok if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score long")


def test_equals_brute_force_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BINS", 8)
    monkeypatch.setattr(topk_search, "CHUNK", 32)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # a third are copies, so the best scores tie
    rows += [(900, None), (901, [float("inf")] * 6), (902, [1.0, None]), (None, rows[0][1]), (903, [0.0] * 6), (904, [2.0])]
    for monkey in (topk_search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(topk_search, "BROADCAST_BYTES", monkey)
        got = topk_search.search(frame(spark, rows), F.col("vec_id") % 10 == 0, k=7)
        assert sorted(map(tuple, got.collect())) == brute(rows, 7, 10)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (10, [0.0, 0.0])]
    got = topk_search.search(frame(spark, rows), F.col("vec_id") % 10 == 0, k=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 10)
    assert topk_search.search(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_repeated_ids_and_fewer_candidates_than_k(spark):
    ids = [0, 0, 0, 100, *range(1, 9)]
    rows = [(i, [float(n % 5), float(i % 3) - n]) for n, i in enumerate(ids)]
    got = {}
    for r in topk_search.search(frame(spark, rows), F.col("vec_id") % 100 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = {i: [np.floor(1024 * np.array(v)).astype(int) for j, v in rows if j == i] for i in set(ids)}
    assert len(got[0]) == 9 and len(got[100]) == 10
    for q, found in got.items():
        a = min(whole[q], key=list)
        want = sorted((-int(a @ b), i) for i in whole if i != q for b in whole[i])[:10]
        assert found == [(i, -s) for s, i in want]


def test_components_of_any_size_are_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [2e5, 0.0]), (2, [3e5, 0.0]), (3, [2.0**40, 2.0**-10]), (4, [-(2.0**41), 3.0]), (5, [float(2**22), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.search(df.where("vec_id <> 3 AND vec_id <> 4"), F.col("vec_id") == 0, k=10)
    assert sorted(map(tuple, got.collect())) == [x for x in brute([r for r in rows if r[0] not in (3, 4)], 10, 100)]
    assert {r.vec_id: r.score for r in got.collect()}[2] == 314572800000000000
    edge = spark.createDataFrame([(0, [2.0**30, 1.0]), (1, [-(2.0**13), 5.0]), (2, [0.0, 7.0]), (3, [1.0 - 2.0**12, -1.0])], "vec_id long, embedding array<double>")
    got = topk_search.search(edge, F.col("vec_id") >= 0, k=3)  # the smallest score is near -2**63
    assert sorted(map(tuple, got.collect())) == brute([(0, [2.0**30, 1.0]), (1, [-(2.0**13), 5.0]), (2, [0.0, 7.0]), (3, [1.0 - 2.0**12, -1.0])], 3, 1)
    with pytest.raises(Exception, match="64-bit"):
        topk_search.search(df, F.col("vec_id") == 3, k=2).collect()
