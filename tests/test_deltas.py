import datetime as dt
import json

from pyspark.sql import functions as F

from memloom import schemas
from memloom.operators import deltas, threads

from .test_memory import memories, stamp, table
from .test_parsers import delta, edge, point

AT = "TIMESTAMP '2024-02-01 00:00:00'"


def test_deltas_become_memories_relations_and_receipts(spark):
    old = memories(spark, {"memory_id": "m1", "content": "old"}, {"memory_id": "m2", "content": "gone", "lifecycle": "superseded"})
    good = json.dumps(delta([point("p1"), point("p2"), point("p3"), point("d", status="defer")], [edge("p1", "p2"), edge("p3", "p1", boundary_policy="context"), edge("p1", "m1", target_kind="memory", boundary_policy="context", lifecycle_effect="supersede")]))
    stale = json.dumps(delta([point("p1")], [edge("p1", "m2", target_kind="memory", boundary_policy="context")]))
    d = spark.createDataFrame([("k1", "s", good, ["m1"]), ("k2", "s", "{", []), ("k3", "s", stale, ["m2"])], "source_key string, scope_key string, payload string, activated array<string>")
    got = deltas.admit_deltas(d, old, table(spark, "relations"), table(spark, "transitions"), F.expr(AT))
    receipts = {r.source_key: r for r in got["receipts"].collect()}
    assert {k: r.status for k, r in receipts.items()} == {"k1": "complete", "k2": "refused", "k3": "refused"}
    assert len(receipts["k1"].memory_ids) == 2 and "malformed" in receipts["k2"].error
    after = {r.memory_id: r for r in got["memories"].collect()}
    assert after["m1"].lifecycle == "superseded" and {after[i].content for i in receipts["k1"].memory_ids} == {"m p1\nm p2", "m p3"}
    assert {(r.relation, r.lifecycle_effect) for r in got["relations"].collect()} == {("r", "none"), ("r", "supersede")}
    again = deltas.admit_deltas(d, got["memories"], got["relations"], got["transitions"], F.expr(AT))
    assert again["memories"].count() == 4 and again["relations"].count() == 2
    assert {r.source_key: r.status for r in again["receipts"].collect()}["k1"] == "complete"
    assert [r.transitioned_at for r in again["transitions"].collect()] == [dt.datetime(2024, 2, 1)]


def test_signals_update_the_thread_they_match(spark):
    schema = "signal_id int, ord long, scope_key string, action string, question string, summary string, support array<string>, mature boolean, at timestamp"
    s = spark.createDataFrame([(1, 1, "s", "track", "Which laptop?", "looking at laptops", ["m1"], False, stamp(1)), (2, 2, "s", "resolve", "Other thing", None, ["m2"], False, stamp(2)), (3, 3, "s", "track", "which  LAPTOP?", None, ["m3"], False, stamp(3))], schema)
    first, outcomes = threads.auto_update(s, spark.createDataFrame([], schemas.of("threads")))
    (t,) = first.collect()
    assert t.open_question == "Which laptop?" and t.current_support_ids == ["m1", "m3"] and outcomes.count() == 2
    more = spark.createDataFrame([(4, 4, "s", "resolve", "which laptop?", "bought one", ["m4"], True, stamp(5))], schema)
    second, _ = threads.auto_update(more, first)
    (t,) = second.collect()
    assert t.status == "resolved" and t.working_summary == "bought one" and t.mature
