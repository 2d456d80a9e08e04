import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom import catalogue, schemas
from memloom.operators import memory, threads

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def stamp(day):
    return dt.datetime(2024, 1, day)


def table(spark, name, rows=()):
    cols = schemas.of(name).names
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], schemas.of(name))


def memories(spark, *rows):
    base = {"scope_key": "s", "source_keys": ["k"], "evidence_refs": [], "occurred_at": stamp(1), "committed_at": stamp(1), "lifecycle": "active"}
    return table(spark, "memories", [{**base, **r} for r in rows])


def test_admission_is_deterministic_and_checks_sources(spark):
    c = spark.createDataFrame([("s", "x", ["k1", "k2"], "o", []), ("s", "x", ["k2", "k1"], "o", []), ("s", "y", ["gone"], "o", []), ("t", "z", ["k1"], "o", [])], "scope_key string, content string, source_keys array<string>, observation_id string, evidence_refs array<string>")
    src = spark.createDataFrame([("s", "k1", stamp(5)), ("s", "k2", stamp(3))], "scope_key string, source_key string, occurred_at timestamp")
    got, refused = memory.admit(c, src, memories(spark), F.expr(NOW))
    (r,) = got.collect()
    assert r.content == "x" and r.occurred_at == stamp(3) and {x.content for x in refused.collect()} == {"y", "z"}
    again, _ = memory.admit(c, src, got, F.expr("TIMESTAMP '2025-01-01 00:00:00'"))
    assert [x.committed_at for x in again.collect()] == [r.committed_at]


def test_insert_is_immutable(spark):
    a, b = memories(spark, {"memory_id": "m", "content": "x"}), memories(spark, {"memory_id": "m", "content": "y"})
    assert memory.insert(a, a).count() == 1
    assert memory.insert(a, memories(spark, {"memory_id": "n", "content": "y"})).count() == 2
    for bad in (b, a.unionByName(b)):
        with pytest.raises(memory.Conflict):
            memory.insert(memories(spark) if bad is not b else a, bad)


def test_lifecycle_and_invalidation(spark):
    m = memories(spark, {"memory_id": "a", "content": "x"}, {"memory_id": "b", "content": "y"}, {"memory_id": "c", "content": "z", "lifecycle": "superseded"})
    src = table(spark, "memory_sources", [{"scope_key": "s", "source_key": "k", "version_key": v, "memory_id": i} for i, v in (("a", "v1"), ("b", "v2"), ("c", "v1"))])
    ref = spark.createDataFrame([("s", "k", "v2", False, stamp(9))], "scope_key string, source_key string, version_key string, deleted boolean, at timestamp")
    changed = memory.stale_memories(m, src, ref)
    assert [r.memory_id for r in changed.collect()] == ["a"]
    assert {r.memory_id for r in memory.stale_memories(m, src, ref.withColumn("deleted", F.lit(True))).collect()} == {"a", "b"}
    none = table(spark, "transitions")
    after, moves = memory.set_lifecycle(m, none, changed)
    assert {r.memory_id: r.lifecycle for r in after.collect()} == {"a": "invalidated", "b": "active", "c": "superseded"}
    _, same = memory.set_lifecycle(after, moves, changed.withColumn("at", F.expr(NOW)))
    assert [r.transitioned_at for r in same.collect()] == [stamp(9)]
    new = spark.createDataFrame([("n", "s", "b", stamp(9))], "memory_id string, scope_key string, supersedes string, committed_at timestamp")
    assert [r.memory_id for r in memory.superseded(m, new).collect()] == ["b"]
    with pytest.raises(memory.Conflict):
        memory.superseded(m, new.withColumn("scope_key", F.lit("other")))


def test_jobs_freeze_once(spark):
    j = table(spark, "jobs", [{"source_key": "k", "registered_at": stamp(1), "done": False}])
    f = spark.createDataFrame([("k", "[1]")], "source_key string, candidates string")
    frozen = memory.freeze_jobs(memory.freeze_jobs(j, f), f)
    assert [r.candidates for r in memory.recoverable(frozen, 5).collect()] == ["[1]"]
    with pytest.raises(memory.Conflict):
        memory.freeze_jobs(frozen, f.withColumn("candidates", F.lit("[2]")))
    with pytest.raises(memory.Conflict):
        memory.complete_jobs(j, f)
    assert memory.recoverable(memory.complete_jobs(frozen, f), 5).count() == 0


def test_change_queue(spark):
    m = memories(spark, {"memory_id": "a", "content": "x"}, {"memory_id": "b", "content": "bad"})
    t = spark.createDataFrame([("dense",)], "target string")
    q = memory.enqueue(table(spark, "projection_queue"), m, t)
    assert memory.enqueue(q, m, t).count() == 2
    write = lambda todo: todo.select("intent_id", F.when(F.col("content") == "x", "ref").alias("provider_ref"), F.when(F.col("content") == "bad", "boom").alias("error"))
    q2, _ = memory.run_projection(q, m, write)
    assert {r.memory_id: (r.status, r.attempts) for r in q2.collect()} == {"a": ("succeeded", 1), "b": ("failed_retryable", 1)}
    assert [r.memory_id for r in memory.poll(q2, 9, "dense").collect()] == ["b"]
    q3 = memory.requeue(q2, spark.createDataFrame([("a",)], "memory_id string"))
    late = q2.where("memory_id = 'a'").select("intent_id", F.lit("old").alias("provider_ref"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("expected_generation"))
    assert {r.memory_id: r.status for r in memory.acknowledge(q3, late).collect()}["a"] == "pending"
    q4, _ = memory.run_projection(q, m.where("memory_id = 'a'"), write)
    assert {r.memory_id: r.last_error for r in q4.collect()}["b"] == "canonical memory missing"


def test_attention(spark):
    m = memories(spark, *[{"memory_id": i, "content": "x", "committed_at": stamp(22)} for i in "abcd"]).withColumn("lifecycle", F.when(F.col("memory_id") == "d", "superseded").otherwise("active"))
    a = table(spark, "attention", [{"memory_id": "a", "importance": 8, "activation_count": 3, "resolved": True, "digested": False, "dont_surface": False}, {"memory_id": "b", "importance": 5, "activation_count": 0, "resolved": False, "digested": True, "dont_surface": True}])
    got = {r.memory_id: r for r in threads.attention(m, a, F.expr(NOW), "automatic").collect()}
    import math

    assert got["a"].score == round(8 * (1 + math.log1p(3)) * math.exp(-0.3) * 0.25, 6)
    assert got["b"].reasons == ["dont_surface", "digested"] and not got["b"].allowed and got["d"].reasons == ["inactive_memory"]
    assert {r.memory_id: r.allowed for r in threads.attention(m, a, F.expr(NOW), "explicit_search").collect()}["b"]
    hits = spark.createDataFrame([("a", stamp(3)), ("a", stamp(4)), ("z", stamp(5))], "memory_id string, at timestamp")
    after = {r.memory_id: (r.activation_count, r.importance, r.last_reinforced_at) for r in threads.reinforce(a, hits).collect()}
    assert after == {"a": (5, 8, stamp(4)), "b": (0, 5, None), "z": (1, 5, stamp(5))}
    change = spark.createDataFrame([("a", 9)], "memory_id string, importance int")
    assert {r.memory_id: r.importance for r in threads.set_attention(a, change).collect()} == {"a": 9, "b": 5}


def test_thread_events_and_matching(spark):
    schema = "thread_id string, ord long, action string, scope_key string, question string, summary string, support array<string>, mature boolean, at timestamp"
    e = spark.createDataFrame(
        [("t", 1, "open", "s", "Which laptop to buy?", "looking", ["m1"], False, stamp(1)), ("t", 2, "update", "s", None, None, [f"m{i}" for i in range(12)], False, stamp(2)), ("t", 3, "retire", "s", None, None, [], False, stamp(3)), ("t", 4, "resolve", "s", None, "bought", ["m9"], False, stamp(4)), ("t", 5, "update", "s", None, None, [], False, stamp(5)), ("t", 6, "retire", "s", None, None, [], False, stamp(6)), ("u", 1, "update", "s", None, None, [], False, stamp(1))],
        schema,
    )
    after, outcomes = threads.apply_thread_events(e, table(spark, "threads"))
    assert {(r.thread_id, r.ord): r.outcome for r in outcomes.collect()} == {("t", 1): "opened", ("t", 2): "update", ("t", 3): "refused", ("t", 4): "resolve", ("t", 5): "refused", ("t", 6): "retire", ("u", 1): "refused"}
    (t,) = after.collect()
    assert t.status == "retired" and t.origin_memory_ids == ["m1"] and len(t.current_support_ids) == 8 and t.working_summary == "bought"
    known = spark.createDataFrame([("a", "s", "open", "Which laptop to buy", "prices of laptops", "", stamp(1)), ("b", "s", "open", "holiday plans", "rome in may", "", stamp(2)), ("c", "x", "open", "Which laptop to buy", "", "", stamp(1))], "thread_id string, scope_key string, status string, open_question string, working_summary string, support_text string, updated_at timestamp")
    sig = spark.createDataFrame([(1, "s", "  which LAPTOP to buy", None), (2, "s", None, "plans for rome in may"), (3, "s", None, "nothing alike"), (4, "s", None, "rome")], "signal_id int, scope_key string, question string, summary string")
    assert {r.signal_id: r.thread_id for r in threads.best_match(sig, known).collect()} == {1: "a", 2: "b"}
    assert {r.signal_id for r in threads.best_match(sig, known, exact_only=True).collect()} == {1}


def test_surfacing_support_and_overlay(spark):
    m = memories(spark, *[{"memory_id": f"m{i}", "content": "x", "committed_at": stamp(i + 1), "observation_id": f"o{i}", "evidence_refs": ["e"]} for i in range(10)])
    t = table(spark, "threads", [{"thread_id": i, "scope_key": "s", "status": st, "importance": 5, "updated_at": stamp(20), "touch_count": n, "suppressed": sup, "current_support_ids": [sid]} for i, st, n, sup, sid in (("a", "open", 1, False, "m1"), ("b", "open", 3, False, "m2"), ("c", "resolved", 9, False, "m1"), ("d", "open", 9, True, "m1"), ("e", "open", 9, False, "gone"))])
    assert [r.thread_id for r in threads.surface_threads(t, m, F.expr(NOW)).orderBy("place").collect()] == ["b", "a"]
    refs = spark.createDataFrame([(1, "s", "e"), (2, "s", "o3"), (2, "s", "m3")], "signal_id int, scope_key string, ref string")
    got = threads.supporting(m, refs).orderBy("signal_id", "place").collect()
    assert [r.memory_id for r in got if r.signal_id == 1] == [f"m{i}" for i in range(2, 10)] and [r.memory_id for r in got if r.signal_id == 2] == ["m3"]
    ev = spark.createDataFrame([("i", 1, "s", "t1", "put"), ("j", 2, "s", "t1", "put"), ("i", 3, "s", "t1", "accept"), ("k", 4, "x", "t2", "put"), ("k", 5, "x", None, "clear"), ("l", 6, "x", "t3", "put")], "item_id string, ord long, scope_key string, turn_id string, action string")
    assert {r.item_id for r in threads.pending_overlay(ev).collect()} == {"j", "l"}


def test_rejections_can_be_reopened(spark):
    p = spark.createDataFrame([("r", " a  b", ["y", "x"], stamp(1), "auth", None), ("r", "a b ", ["x", "y", "y"], stamp(2), "auth", None), ("r", "c", ["x"], stamp(1), "auth", None)], "region_id string, content string, source_refs array<string>, rejected_at timestamp, authority_ref string, reason string")
    ledger = threads.reject(table(spark, "rejections"), p)
    assert ledger.count() == 2 and threads.reject(ledger, p).count() == 2
    assert threads.not_rejected(p, ledger).count() == 0
    one = ledger.where("rejected_content = 'c'").select("rejection_id", F.expr(NOW).alias("reopened_at"), F.lit("boss").alias("authority_ref"))
    opened = threads.reopen(ledger, one)
    assert opened.count() == 2 and [r.content for r in threads.not_rejected(p, opened).collect()] == ["c"]
    assert threads.relevant_rejections(opened, [], ["y"]).count() == 1 and threads.relevant_rejections(opened, ["r"], []).count() == 1


def test_known_lines(spark):
    rows = [("due 2024-02-01 06:00", None, False, stamp(1), "tax form", 0), ("later 2024-03-01", None, False, stamp(2), "dentist visit", 1), ("settled 2024-01-01", None, True, stamp(3), "old tax", 2), ("fresh", "s", False, stamp(30), "garden", 3), ("cue", "s", False, stamp(4), "rome holiday plans", 4)]
    cards = spark.createDataFrame(rows, "question string, summary string, settled boolean, last_active timestamp, search_text string, ord long")
    got = {r.question: r.route for r in threads.select_known_lines(cards, "we go to rome", F.expr(NOW), recent=1).collect()}
    assert got == {"due 2024-02-01 06:00": "due", "fresh": "recent", "cue": "cued"}


def test_supersede_chain_goes_to_the_end(spark):
    links = lambda rows: spark.createDataFrame(rows, "memory_id string, superseded_by string")
    chain = [(f"m{i}", f"m{i + 1}") for i in range(150)]
    got = {r.memory_id: (r.head, r.steps) for r in memory.supersede_chain(links([*chain, ("m148", "side"), ("x", "y")])).collect()}
    assert got == {f"m{i}": ("m150", 150 - i) for i in range(150)} | {"x": ("y", 1)}
    with pytest.raises(memory.Conflict):
        memory.supersede_chain(links([("a", "b"), ("b", "c"), ("c", "b")]))
    assert memory.supersede_chain(links(chain).limit(0)).collect() == []


def test_supersede_chain_query_takes_long_conversations(spark, tmp_path):
    spark.range(12).selectExpr("1L AS conv_id", "CAST(id AS int) AS turn", "'user' AS role", "'t' AS text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in catalogue.supersede_chain(spark, str(tmp_path)).select("memory_id", "head", "steps").collect()}
    assert got == {(f"1:{i}", "1:11", 11 - i) for i in range(11)}
