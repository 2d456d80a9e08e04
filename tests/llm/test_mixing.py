from collections import Counter
from fractions import Fraction

import pytest

from memloom.llm import mixing

from .helpers import docs_frame


def check(rows, weights):
    """Every phase keeps each live source within one block of its share."""
    left = Counter(r["source"] for r in {(r["source"], r["block"]): r for r in rows}.values())
    order = sorted({(r["slot"], r["source"], r["block"]) for r in rows})
    assert [s for s, _, _ in order] == list(range(len(order)))
    done, t = Counter(), 0
    live = set(left)
    for _, s, _ in order:
        total = sum(weights[x] for x in live)
        done[s] += 1
        t += 1
        for x in live:
            assert abs(done[x] - Fraction(weights[x], total) * t) < 1
        left[s] -= 1
        if not left[s]:
            live.discard(s)
            done, t = Counter(), 0


def test_shares_hold_until_each_source_ends(spark):
    rows = [(i, "t", "abc"[i % 3] if i < 90 else "a") for i in range(300)]
    got = [r.asDict() for r in mixing.assign(docs_frame(spark, rows), {"a": 5, "b": 2, "c": 1}, block_rows=4).collect()]
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    assert sorted(r["position"] for r in got) == list(range(300))
    sizes = Counter((r["source"], r["block"]) for r in got)
    assert max(sizes.values()) == 4
    weights = {"a": 1000, "b": 400, "c": 200}
    check(got, weights)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "x", None), (1, "x", None), (None, None, None), (2, "", "a"), (2, "", "a")]
    got = mixing.assign(docs_frame(spark, rows)).collect()
    assert len(got) == 5 and sorted(r.position for r in got) == [0, 1, 2, 3, 4]
    assert mixing.assign(docs_frame(spark, rows).limit(0)).collect() == []


def test_mix_keeps_rows_and_columns_in_order(spark):
    rows = [(i, f"t{i}", "ab"[i % 7 == 0]) for i in range(200)]
    df = docs_frame(spark, rows)
    out = mixing.mix(df, {"a": 1, "b": 1}, rows_per_file=50)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
    head = [r.source for r in out.collect()[:20]]
    assert 8 <= head.count("b") <= 12


def test_odd_column_names_small_weights_and_a_hot_null_id(spark):
    df = spark.createDataFrame([(None, "a", i, "x") for i in range(300)] + [(1, "b", 0, "y")] * 2, "doc_id long, source string, `back``tick` int, alike string")
    out = mixing.mix(df, {"a": 1.0, "b": 0.0001})
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    counts = spark.createDataFrame([("=a", 5), ("=b", 5)], "src string, n long")
    assert {r.src: r.a for r in mixing.integer_weights(counts, {"a": 1.0, "b": 0.0001}, 10).collect()} == {"=a": 1_000_000, "=b": 100}
    with pytest.raises(ValueError, match="1/1000000"):
        mixing.integer_weights(counts, {"a": 1.0, "b": 1e-8}, 10)
