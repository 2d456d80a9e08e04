import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memloom.functions.text import lexical_tokens
from memloom.operators import decision, dense, fusion, lexical, retrieval
from memloom.plans import search


def bm25_by_hand(docs, query, k1=1.5, b=0.75):
    toks = {i: lexical_tokens(t) for i, t in docs.items()}
    toks = {i: t for i, t in toks.items() if t}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for term in set(lexical_tokens(query)):
        df = sum(term in t for t in toks.values())
        for i, t in toks.items():
            tf = Counter(t)[term]
            if tf:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
    return sorted(((i, round(s, 6)) for i, s in out.items()), key=lambda x: (-x[1], x[0]))


def test_bm25_counts_within_its_scope(spark):
    docs = {"a": "red apple pie", "b": "apple apple", "c": "green pear", "d": "", "e": "red red wine tonight"}
    rows = [("s", i, t) for i, t in docs.items()] + [("other", "z", "apple red pie")]
    df = spark.createDataFrame(rows, "scope string, id string, text string")
    q = spark.createDataFrame([("q1", "s", "Red APPLE apple"), ("q2", "s", "!!"), ("q3", "none", "apple")], "question_id string, scope string, text string")
    got = lexical.bm25(df, q, 10).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got if r.question_id == "q1"] == bm25_by_hand(docs, "red apple")
    assert {r.question_id for r in got} == {"q1"}
    with pytest.raises(ValueError):
        lexical.bm25(df, q, 10, k1=0)


def test_nearest_by_both_routes(spark, monkeypatch):
    v = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 2, [0.6, 0.8]), (0, 3, [0.0, 0.0]), (0, 4, [2.0, 0.0]), (1, 5, [1.0, 0.0])], "scope int, id long, vector array<float>")
    q = spark.createDataFrame([("q", 0, [1.0, 0.0])], "question_id string, scope int, vector array<float>")
    want = [(1, 1.0), (4, 1.0), (2, 0.6)]
    assert [(r.id, r.score) for r in dense.nearest(v, q, 5).orderBy("rank").collect()] == want
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 0)
    assert [(r.id, r.score) for r in dense.nearest(v, q, 5).orderBy("rank").collect()] == want


def hits(spark, rows):
    return spark.createDataFrame(rows, "question_id string, arm string, rank int, id string")


def test_fusion_keeps_slots_of_repeats_and_breaks_ties_by_rank(spark):
    h = hits(spark, [("q", "x", 1, "m1"), ("q", "x", 2, "m1"), ("q", "x", 3, "m2"), ("q", "y", 1, "m2"), ("q", "y", 2, "m3")])
    got = fusion.fuse(h, {"x": 1.0, "y": 1.0}, 10).orderBy("rank").collect()
    assert [r.id for r in got] == ["m2", "m1", "m3"]
    assert got[0].refs == "x:m2|y:m2" and got[0].score == round(1 / 63 + 1 / 61, 9)
    assert fusion.candidate_limit(10) == 40 and fusion.candidate_limit(60) == 100 and fusion.candidate_limit(120) == 100
    with pytest.raises(ValueError):
        fusion.fuse(h, {"x": 1.0}, 10)


def test_upward_fusion_and_closest(spark):
    raw = spark.createDataFrame([("q", 1, "r1"), ("q", 2, "r2")], "question_id string, rank int, id string")
    of = spark.createDataFrame([("r1", "b1", 0), ("r1", "b2", 1), ("r2", "b3", 0)], "record_id string, block_id string, ord long")
    own = spark.createDataFrame([("q", 1, "b3"), ("q", 2, "b9")], "question_id string, rank int, id string")
    assert [r.id for r in fusion.upward(raw, of, own, 9).orderBy("rank").collect()] == ["b3", "b1", "b2", "b9"]
    close = spark.createDataFrame([("q", "b2", 0.9), ("q", "b1", 0.1)], "question_id string, block_id string, relevance double")
    assert [r.id for r in fusion.upward(raw, of, own, 9, closest=close).orderBy("rank").collect()] == ["b3", "b2", "b9"]


def test_hyde_only_helps_sparse_questions(spark):
    cols = "question_id string, rank int, id string"
    o = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z")], cols)
    h = spark.createDataFrame([("a", 1, "n"), ("a", 2, "x"), ("b", 1, "n")], cols)
    got = {(r.question_id, r["rank"]): r.id for r in fusion.hyde_fallback(o, h, 5).collect()}
    assert got == {("a", 1): "x", ("a", 2): "n", ("b", 1): "x", ("b", 2): "y", ("b", 3): "z"}
    assert {r.id for r in fusion.hyde_augmented(o, h, 5).where("question_id = 'b'").collect()} == {"x", "y", "z", "n"}


def test_budgets_caps_and_reranking(spark):
    rows = [("q", i, f"i{i}", "x" * n) for i, n in enumerate([5, 9, 3, 2], 1)]
    c = spark.createDataFrame(rows, "question_id string, rank int, id string, content string")
    assert {r.id for r in retrieval.greedy_budget(c, 10, 10).collect()} == {"i1", "i3", "i4"}
    assert {r.id for r in retrieval.greedy_budget(c, 2, 10).collect()} == {"i1", "i3"}
    assert retrieval.greedy_budget(c, 0, 10).count() == 0
    sized = c.select("question_id", "rank", "id", F.length("content").alias("size"), F.lit(1).alias("cost"))
    assert {r.id for r in retrieval.prefix_budget(sized, 14).collect()} == {"i1", "i2"}
    assert {r.id for r in retrieval.prefix_budget(sized, 100, 3).collect()} == {"i1", "i2", "i3"}
    two = sized.withColumn("carried", F.col("rank") > 2).withColumn("cost", F.lit(4))
    assert {r.id for r in retrieval.readout_budget(two, 12).collect()} == {"i1", "i2", "i3"}
    assert {r.id for r in retrieval.cap(sized, 2, F.col("id") == "i1").collect()} == {"i2", "i3"}
    order = spark.createDataFrame([("q", f"i{i}", p) for p, i in enumerate([4, 3, 2, 1])], "question_id string, id string, place int")
    assert [r.id for r in retrieval.rerank(c, order).orderBy("rank").collect()] == ["i4", "i3", "i2", "i1"]
    assert [r.id for r in retrieval.rerank(c, order.where("place > 0")).orderBy("rank").collect()] == ["i1", "i2", "i3", "i4"]


def test_revalidation_and_exact_selection(spark):
    m = spark.createDataFrame([("a", "s", "active", "x"), ("b", "s", "superseded", "y"), ("c", "t", "active", "z")], "id string, scope string, lifecycle string, content string")
    h = spark.createDataFrame([("q", 1, "b"), ("q", 2, "a"), ("q", 3, "a"), ("q", 4, "c")], "question_id string, rank int, id string")
    q = spark.createDataFrame([("q", "s")], "question_id string, scope string")
    assert [(r.id, r["rank"]) for r in retrieval.revalidate(h, m, q).collect()] == [("a", 2)]
    want = spark.createDataFrame([("s", 1, "a")], "scope string, pos int, id string")
    assert [r.content for r in retrieval.select_exact(m, want, 5).collect()] == ["x"]
    for bad in ([("s", 1, "a"), ("s", 2, "a")], [("s", 1, "b")], [("s", 1, "c")], [("s", 1, "zz")]):
        with pytest.raises(ValueError):
            retrieval.select_exact(m, spark.createDataFrame(bad, want.schema), 5)


def test_projection_and_support_order(spark):
    c = spark.createDataFrame([("q", "a", 3, 0.1), ("q", "b", None, 0.9), ("q", "c", 5, 0.8), ("q", "d", 50, None)], "question_id string, id string, best_rank int, cosine double")
    assert [r.id for r in retrieval.select_projections(c, 5, 10, 0.5).orderBy("place").collect()] == ["c", "a", "b"]
    s = spark.createDataFrame([("p", "a", None, 1), ("p", "b", None, 2), ("p", "c", 4, 0)], "parent string, id string, query_rank int, t int").withColumn("occurred_at", F.timestamp_seconds("t"))
    assert [r.id for r in retrieval.support_order(s, 2).orderBy("place").collect()] == ["c", "b"]
    assert [r.id for r in retrieval.support_order(s, 2, by_time=True).orderBy("place").collect()] == ["c", "b"]


def test_question_checks(spark):
    q = spark.createDataFrame([("1", "u", "what", 5, ["x", "y"]), ("2", "u", " ", 5, None), ("3", "u", "w" * 5000, None, None), ("4", "u", "w", 101, None)], "question_id string, user_id string, query string, top_k int, options array<string>")
    ok, bad = search.prepare_questions(q)
    got = {r.question_id: r for r in ok.collect()}
    assert got["1"].text == "what\nx\ny" and len(got["3"].text) == 4096 and got["3"].top_k == 100
    assert {r.question_id for r in bad.collect()} == {"2", "4"}


def test_contradictions(spark):
    rows = [("a", 1, "m1", "user", 0.9, 0.1), ("a", 2, "m2", "user", 0.2, 0.7), ("a", 3, "m3", "assistant", 1.0, 1.0), ("b", 1, "m4", "user", 0.9, 0.9), ("c", 1, "m5", "user", 0.9, 0.1), ("c", 2, "m6", "user", 0.1, 0.4)]
    s = spark.createDataFrame(rows, "question_id string, rank int, id string, role string, affirm double, deny double")
    assert [tuple(r) for r in decision.contradictions(s).collect()] == [("a", "m1", "m2")]
