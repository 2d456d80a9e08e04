import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import graph, tense

T = [dt.datetime(2024, 1, 1, h) for h in range(12)]


def at(h):
    return F.expr(f"TIMESTAMP '2024-01-01 {h:02d}:00:00'")


def revisions(spark, rows):
    df = spark.createDataFrame([("L", p, c, T[k], None if r is None else T[r]) for p, c, k, r in rows], "line_id string, parent string, child string, known_at timestamp_ntz, retired_at timestamp_ntz")
    return df.withColumn("known_at", F.col("known_at").cast("timestamp")).withColumn("retired_at", F.col("retired_at").cast("timestamp"))


def edges(spark, *pairs):
    return spark.createDataFrame([("L", *p) for p in pairs], "line_id string, parent string, child string")


def nodes(spark, *names):
    return spark.createDataFrame([("q", n) for n in names], "question_id string, node string")


def test_intervals_are_half_open_and_retiring_keeps_history(spark):
    r = revisions(spark, [("a", "b", 2, 5), ("a", "c", 3, None)])
    seen = {h: {(x.parent, x.child) for x in graph.edges_at(r, at(h)).collect()} for h in (1, 2, 4, 5, 9)}
    assert seen == {1: set(), 2: {("a", "b")}, 4: {("a", "b"), ("a", "c")}, 5: {("a", "c")}, 9: {("a", "c")}}
    gone = edges(spark, ("a", "c"), ("a", "b")).withColumn("at", at(7))
    after = graph.retire(r, gone, ["line_id", "parent", "child"])
    assert {(x.child, x.retired_at) for x in after.collect()} == {("b", T[5]), ("c", T[7])}


def test_closures_paths_and_pieces(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "c2"), ("c2", "d"), ("c", "d"), ("x", "y"))
    up = {(r.start, r.node): r.depth for r in graph.ancestors(spark.createDataFrame([("d",)], "start string"), e).collect()}
    assert up == {("d", "c"): 1, ("d", "c2"): 1, ("d", "b"): 2, ("d", "a"): 2}
    assert {r.node for r in graph.descendants(spark.createDataFrame([("a",)], "start string"), e, most=1).collect()} == {"b", "c2"}
    visible = spark.createDataFrame([("L", n) for n in "a b c c2 d x y".split()], "line_id string, node_id string")
    paths = {tuple(r.path) for r in graph.paths_to_frontier(visible, e).collect()}
    assert paths == {("a", "b", "c", "d"), ("a", "c2", "d"), ("x", "y")}
    with pytest.raises(ValueError):
        graph.paths_to_frontier(visible, e, max_paths=2)
    with pytest.raises(ValueError):
        graph.paths_to_frontier(visible, e, max_nodes=2)
    got = {r.node: r.piece for r in graph.components(nodes(spark, "a", "b", "d", "x", "y"), e).collect()}
    assert got == {"a": "a", "b": "a", "d": "d", "x": "x", "y": "x"}


def test_components_of_a_long_chain(spark):
    n = 40
    order = list(range(n))
    random.Random(1).shuffle(order)
    e = edges(spark, *[(f"{order[i]:03d}", f"{order[i + 1]:03d}") for i in range(n - 1)])
    assert {r.piece for r in graph.components(nodes(spark, *[f"{i:03d}" for i in range(n)]), e).collect()} == {"000"}


def test_near_and_between(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "z"))
    assert {r.node for r in graph.near(nodes(spark, "c"), e, 2).collect()} == {"a", "b", "d", "e", "z"}
    assert {r.node for r in graph.between(nodes(spark, "a", "d"), e, 2).collect()} == {"b", "c"}
    assert graph.between(nodes(spark, "a", "e"), e, 2).count() == 0


def test_edge_inserts_refuse_what_a_line_forbids(spark):
    rows = [("L", 1, "add", "a", "b", 1), ("L", 2, "add", "b", "c", 2), ("L", 3, "add", "a", "c", 3), ("L", 4, "add", "c", "a", 4), ("L", 5, "add", "a", "a", 4), ("L", 6, "retire", "b", "c", 5), ("L", 7, "add", "c", "b", 6), ("L", 8, "add", "c", "a", 2), ("K", 9, "add", "k", "a", 6), ("L", 10, "retire", "q", "r", 6)]
    df = spark.createDataFrame([(l, o, a, p, c, "after", T[h]) for l, o, a, p, c, h in rows], "line_id string, ord long, action string, parent string, child string, kind string, at timestamp_ntz")
    got = {r.ord: r.outcome for r in graph.insert_edges(df).collect()}
    assert got == {1: "added", 2: "added", 3: "implied", 4: "cycle", 5: "self", 6: "retired", 7: "added", 8: "cycle", 9: "other_line", 10: "unknown"}


def test_states_and_raw_closure(spark):
    s = spark.createDataFrame(
        [("n1", "s1", T[1], T[1], True, ["k1"], True), ("n1", "s2", T[3], T[3], True, ["k2"], False), ("n1", "s3", T[4], T[4], False, ["k3"], True), ("n0", "s0", T[0], T[0], True, ["k0"], True)],
        "node_id string, state_id string, knowledge_at timestamp_ntz, created_at timestamp_ntz, readable boolean, source_keys array<string>, evidence_complete boolean",
    ).withColumn("knowledge_at", F.col("knowledge_at").cast("timestamp"))
    assert {r.node_id: r.state_id for r in graph.state_at(s, at(2)).collect()} == {"n1": "s1", "n0": "s0"}
    assert {r.node_id: r.state_id for r in graph.state_at(s, at(9)).collect()} == {"n1": "s2", "n0": "s0"}
    m = spark.createDataFrame([("n0", T[0], None), ("n1", T[0], None)], "node_id string, known_at timestamp_ntz, retired_at timestamp_ntz")
    m = m.withColumn("known_at", F.col("known_at").cast("timestamp")).withColumn("retired_at", F.col("retired_at").cast("timestamp"))
    e = edges(spark, ("n0", "n1"))
    (r,) = graph.raw_closure(spark.createDataFrame([("n1",)], "start string"), e, m, s, at(9)).collect()
    assert r.source_keys == ["k0", "k2"] and r.complete is False
    with pytest.raises(ValueError):
        graph.raw_closure(spark.createDataFrame([("n1",)], "start string"), e, m, s, at(9), max_nodes=1)


def test_tree_report(spark):
    labels = spark.createDataFrame([("L", n, n.upper()) for n in "abc"], "line_id string, node string, label string")
    rows = graph.tree_report(edges(spark, ("a", "b"), ("b", "c")), labels).orderBy("place").collect()
    assert [r.text for r in rows] == ["- A", "  - B", "    - C"]


def test_the_terminator_moves_with_time(spark):
    b = spark.createDataFrame([("m1", "done"), ("m2", "by 2024-01-01 05:00"), ("m3", "open"), ("m4", "on no line")], "memory_id string, content string")
    said = spark.createDataFrame([("m1", True, 0), ("m1", False, 1), ("m2", False, 0), ("m3", False, 0)], "memory_id string, happened boolean, known_at int")
    settled = spark.createDataFrame([("m3", T[6], "x"), ("m3", T[4], "w")], "memory_id string, settled_at timestamp_ntz, by_memory_id string").withColumn("settled_at", F.col("settled_at").cast("timestamp"))
    early = {r.memory_id: (r.side, r.confirmed) for r in tense.sides(b, said, settled, at(3)).collect()}
    late = {r.memory_id: (r.side, r.confirmed) for r in tense.sides(b, said, settled, at(6)).collect()}
    assert early == {"m1": ("happened", True), "m2": ("in progress", False), "m3": ("in progress", False), "m4": (None, None)}
    assert late == {"m1": ("happened", True), "m2": ("happened", False), "m3": ("happened", True), "m4": (None, None)}
    assert [r.by for r in tense.settled_by(settled, at(9)).collect()] == [["w", "x"]]
    sig = spark.createDataFrame([("B", 2, "y", T[1], "b1"), ("B", 2, "y", T[1], "b2"), ("B", 2, "y", T[1], "n7")], "batch_id string, ord long, memory_id string, at timestamp_ntz, ref string").unionByName(spark.createDataFrame([("B", 1, "x", T[1], "n8")], "batch_id string, ord long, memory_id string, at timestamp_ntz, ref string"))
    known = spark.createDataFrame([("n7", "old")], "node_id string, block_id string")
    got = {(r.by_memory_id, r.memory_id, r.ok) for r in tense.settle_references(sig, known).collect()}
    assert got == {("y", "x", True), ("y", None, False), ("y", "old", True), ("x", None, False)}


def test_outline_of_a_long_chain_and_intents_for_many_targets(spark):
    from memloom import schemas
    from memloom.operators import memory

    n = 70
    edges = spark.createDataFrame([("l", i, i + 1) for i in range(n)], "line_id string, parent long, child long")
    labels = spark.createDataFrame([("l", i, f"n{i}") for i in range(n + 1)], "line_id string, node long, label string")
    assert {r.node: r.depth for r in graph.tree_report(edges, labels).collect()} == {i: i for i in range(n + 1)}
    targets = spark.range(1500).selectExpr("CAST(id AS string) AS target")
    memories = spark.createDataFrame([("a",), ("b",)], "memory_id string")
    assert memory.enqueue(spark.createDataFrame([], schemas.of("projection_queue")), memories, targets).count() == 3000
