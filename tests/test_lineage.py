import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.operators import lineage, parsers

D = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def empty(spark):
    return spark.createDataFrame([], lineage.LINEAGE)


def test_promotions_append_revisions_and_replay_adds_nothing(spark):
    s = spark.createDataFrame([("r", 1, "one", ["m1"], D[0]), ("r", 2, "two", ["m2"], D[1]), ("r", 3, "two", ["m1"], D[2]), ("q", 1, "x", ["m9"], D[0])], "region string, ord long, content string, support array<string>, at timestamp")
    first = lineage.promote(empty(spark), s)
    rows = {(r.region, r.revision): r for r in first.collect()}
    assert set(rows) == {("r", 1), ("r", 2), ("q", 1)} and rows["r", 2].support == ["m1", "m2"]
    assert (rows["r", 1].origin, rows["r", 2].origin) == ("commit", "revision")
    assert lineage.promote(first, s.where("ord > 1")).count() == 3
    m = spark.createDataFrame([("m1", "active", D[0]), ("m2", "active", D[3]), ("m9", "superseded", D[1])], "memory_id string, lifecycle string, occurred_at timestamp")
    heads = {r.region: r for r in lineage.accepted(first, m).collect()}
    assert heads["r"].content == "two" and heads["r"].evidence_complete and heads["r"].newest == D[3] and not heads["q"].evidence_complete
    t = spark.createDataFrame([("t1", "r", ["m1"]), ("t2", "r", ["m7", "m2"]), ("t3", "none", ["m1"])], "thread_id string, region string, support array<string>")
    m2 = m.unionByName(spark.createDataFrame([("m7", "active", D[6])], m.schema))
    assert {r.thread_id for r in lineage.superseded_threads(t, lineage.accepted(first, m), m2).collect()} == {"t2", "t3"}


def test_signals_are_routed(spark):
    known = lineage.promote(empty(spark), spark.createDataFrame([("r", 1, "one", ["m"], D[0])], "region string, ord long, content string, support array<string>, at timestamp"))
    s = spark.createDataFrame([("r", 1, "track", "a", True, False), ("n", 2, "resolve", "b", True, False), ("n", 3, "track", "c", False, True), ("r", 4, "track", "d", None, None)], "region string, ord long, action string, content string, settles boolean, commit boolean")
    up, events = lineage.route_signals(s, known)
    assert {r.content for r in up.collect()} == {"a", "c"} and {r.content for r in events.collect()} == {"b", "d"}


def test_placements_and_their_tables(spark):
    p = spark.createDataFrame([("u", 1, 1, "m1", None, False, True), ("u", 1, 2, "m2", "b1", True, False), ("u", 1, 3, "m3", "b9", False, True), ("u", 2, 1, "m4", "n0", False, True), ("u", 2, 2, "m5", "b2", False, True)], "user_id string, batch long, ord long, memory_id string, after string, part boolean, happened boolean")
    nodes = spark.createDataFrame([("n0", "L0")], "node_id string, line_id string")
    got = {r.memory_id: r for r in lineage.apply_placements(p, nodes).collect()}
    assert got["m2"].parent == got["m1"].node_id and got["m2"].kind == "part" and got["m2"].line_id == got["m1"].line_id
    assert got["m3"].failure == "dropped ref b9" and got["m3"].parent is None and got["m5"].failure == "dropped ref b2"
    assert got["m4"].line_id == "L0" and got["m4"].parent == "n0" and got["m4"].kind == "after"
    tables = lineage.placed_tables(lineage.apply_placements(p, nodes), F.expr("TIMESTAMP '2024-02-01 00:00:00'"))
    assert {k: v.count() for k, v in tables.items()} == {"nodes": 5, "edges": 2, "edge_revisions": 2, "node_memberships": 5, "said": 5}


def test_reader_pieces(spark):
    refs = spark.createDataFrame([("q", 1, "p", "k2", D[1]), ("q", 1, "p", "k1", D[1]), ("q", 1, "p", "k0", D[2]), ("q", 2, "o", "k1", D[0])], "question_id string, parent_rank int, parent string, source_key string, occurred_at timestamp")
    assert [(r.parent, r.source_key) for r in lineage.source_items(refs, 2).orderBy("place").collect()] == [("p", "k1"), ("p", "k2")]
    s = spark.createDataFrame([("w", f"t{i}", i, c) for i, c in enumerate([0.9, 0.1, 0.8, 0.2, 0.3])], "window_id string, stretch_id string, last_seq long, cosine double")
    assert [r.stretch_id for r in lineage.earlier_stretches(s, 2, 4).orderBy("place").collect()] == ["t4", "t3", "t0", "t2"]
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "memory_id string")
    rel = spark.createDataFrame([("a", "b", "supports")], "from_memory_id string, to_memory_id string, relation string")
    view = {r.memory_id: [tuple(x) for x in r.relations] for r in lineage.block_view(m, spark.createDataFrame([("a", "p")], "memory_id string, members string"), rel).collect()}
    assert view == {"a": [("out", "supports", "b")], "b": [("in", "supports", "a")], "c": []}
    text = spark.range(1).select(lineage.matter_text(F.lit("Ongoing"), F.expr("TIMESTAMP '2024-01-02 03:04:00'"), F.lit("what?"), F.array(F.lit("x"), F.lit("y")), F.lit("so")))
    assert text.first()[0] == "[Ongoing | last update 2024-01-02 03:04] what?\nSteps in order:\n1. x\n2. y\nCurrent state: so"


def test_journals_and_compiler_views():
    blocks = [{"content": "a", "sources": ["r1"], "standing": True, "under": 0}, {"content": "b", "sources": [], "settles": []}]
    back = parsers.blocks_from_json(parsers.blocks_to_json(blocks, "v1"))
    assert back[0]["standing"] and back[0]["under"] == 0 and back[1] == {"content": "b", "sources": [], "lines": [], "settles": [], "standing": False, "spans": {}, "pointers": None, "under": None}
    assert parsers.frozen({"b": [1, {2}], "a": None}) == (("a", None), ("b", (1, frozenset({2}))))
    with pytest.raises(ValueError):
        parsers.frozen(object())
    long = "word " * 100
    assert parsers.compiler_view("user", long, 40) == long and parsers.compiler_view("assistant", "short", 40) == "short"
    view = parsers.compiler_view("assistant", long, 40)
    assert len(view) == 43 and " … " in view
    many = "\n\n".join([long, "```\n" + "x" * 300 + "\n```", "end"])
    shown = parsers.compiler_view("assistant", many, 100, numbered=True)
    from memloom.functions.text import paragraphs

    assert len(paragraphs(shown)) == 3 and len(shown) < len(many)
