import json
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import history
from memloom.operators.history import WindowPolicy, all_cuts, next_cut
from memloom.plans import ingest
from memloom.sources import requests as rq
from memloom.sources.store import Store, current_refs, embed_cached, messages_where, upsert_vectors
from memloom.streaming import windows as stream


def messages(spark, rows):
    return spark.createDataFrame(rows, "user_id string, session_id string, record_id string, role string, content string, occurred_at timestamp_ntz, seq long, time_given boolean").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def history_rows(n=120, seed=1):
    import datetime as dt

    r, t, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        t += dt.timedelta(minutes=r.choice([1, 5, 200]))
        out.append((f"u{i % 3}", f"s{i // 20}", f"r{i}", r.choice(["user", "assistant", "system"]), "x" * r.randrange(1, 60), t, i, r.random() < 0.7))
    return out


def test_places_and_session_times(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, 1, h) for h in range(6)]
    rows = [("u", "B", "r0", "user", "a", t[0], 1, True), ("u", "A", "r1", "user", "a", t[1], 2, False), ("u", "B", "r2", "user", "a", t[2], 3, False), ("u", "A", "r3", "user", "a", t[3], 4, True), ("u", "A", "r4", "user", "a", t[4], 5, False)]
    m = messages(spark, rows)
    assert {r.record_id: r.session_no for r in history.places(m).collect()} == {"r0": 1, "r1": 2, "r2": 1, "r3": 2, "r4": 2}
    assert {r.record_id: r.session_at for r in history.session_times(m).collect()} == {"r2": t[0], "r4": t[3]}
    assert {r.record_id: r.context for r in history.context_before(m, 2).collect()}["r4"] == ["r1", "r3"]


@pytest.mark.parametrize(
    ("sizes", "breaks", "policy", "final", "want"),
    [
        ([1] * 5, [False] * 5, WindowPolicy(3, 10), False, None), ([1] * 5, [False, False, False, True, False], WindowPolicy(3, 10), False, 3), ([1] * 5, [False, True, False, False, False], WindowPolicy(3, 10), True, 5),
        ([4] * 5, [False] * 5, WindowPolicy(5, 10), False, 2), ([40], [False], WindowPolicy(5, 10), False, 1), ([1] * 9, [False, False, False, True] + [False] * 5, WindowPolicy(50, 90, max_messages=6), False, 3),
        ([1] * 9, [False, True] + [False] * 7, WindowPolicy(50, 90, max_messages=6), False, 6), ([], [], WindowPolicy(), True, None),
    ],
)
def test_window_ends(sizes, breaks, policy, final, want):
    assert next_cut(sizes, breaks, policy, final) == want


def test_cuts_cover_everything_once():
    r = random.Random(0)
    for _ in range(50):
        sizes = [r.randrange(0, 30) for _ in range(40)]
        cuts = all_cuts(sizes, [r.random() < 0.3 for _ in sizes], WindowPolicy(40, 90, max_messages=r.choice([0, 7])))
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == 40


def test_tail_start():
    assert history.tail_start(["user", "assistant", "assistant"]) == 1 and history.tail_start(["user"]) is None and history.tail_start(["assistant"]) is None
    assert history.tail_start(["assistant", "user", "user"], work=False) == 1 and history.tail_start(["user", "user"], work=False) is None


def test_stream_and_batch_cut_alike(spark, tmp_path):
    m = messages(spark, history_rows())
    policy = WindowPolicy(60, 150, chars=True)
    batch = {tuple(r) for r in history.cut_windows(m, policy, final=False).drop("raw_only").collect()}
    src = str(tmp_path / "in")
    for k in range(3):
        m.where((F.col("seq") >= k * 40) & (F.col("seq") < k * 40 + 40)).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    q = stream.window_stream(s, policy).writeStream.foreachBatch(stream.first_wins_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = spark.read.schema(stream_schema(spark)).parquet(out)
    assert {tuple(r) for r in closed.collect()} == batch
    rest = stream.flush(m, closed, policy)
    assert closed.unionByName(rest).agg(F.sum("n")).first()[0] == 120


def stream_schema(spark):
    return spark.createDataFrame([], stream.CLOSED).schema


def body(request_id, *texts, **more):
    return json.dumps({"request_id": request_id, "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": t, "timestamp": 1_690_000_000_000 + i * 60_000} for i, t in enumerate(texts)], **more})


def test_request_checks():
    ok = rq.checked(body("r", [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": ""}, {"type": "text", "text": "b"}]))
    assert ok["error"] is None and ok["messages"][0]["content"] == "a\nb"
    assert rq.checked(body("r", "x"))["payload_hash"] == rq.checked(body("other", "x"))["payload_hash"]
    for bad in ("{", "[]", body(" ", "x"), body("r"), json.dumps({"request_id": "r", "user_id": "u", "session_id": "s", "messages": [{"role": "user", "content": "x", "timestamp": True}]}), body("r", 5)):
        assert rq.checked(bad)["error"]


def test_ingest_is_idempotent_and_first_write_wins(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    at = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    send = lambda *bodies: spark.createDataFrame([(b,) for b in bodies], "body string")
    policy = WindowPolicy(2, 4)
    first = ingest.add(store, send(body("r1", "hello", "again"), body("r2", "third"), "junk"), at, policy, final=True)
    assert [r.error for r in first.collect()] == ["malformed JSON"]
    assert [r.seq for r in store.read("messages").orderBy("seq").collect()] == [1, 2, 3]
    memories = {r.memory_id for r in store.read("memories").collect()}
    assert len(memories) == 3
    again = ingest.add(store, send(body("r1", "hello", "again"), body("r2", "changed")), at, policy, final=True)
    assert [r.error for r in again.collect()] == ["replayed with other content"]
    assert store.read("messages").count() == 3 and {r.memory_id for r in store.read("memories").collect()} == memories
    ingest.add(store, send(body("r3", "more")), at, policy, final=True)
    assert store.read("messages").agg(F.max("seq")).first()[0] == 4 and store.read("memories").count() == 4
    assert messages_where(store.read("messages"), user_id="u", first_seq=2, last_seq=3).count() == 2
    refs = spark.createDataFrame([("raw", "r1:0", "u", "s"), ("raw", "r1:0", "u", "other"), ("else", "r1:0", "u", "s")], "namespace string, record_id string, user_id string, session_id string")
    assert current_refs(refs, store.read("messages"), "raw").count() == 1
    with pytest.raises(PermissionError):
        Store(spark, store.root, read_only=True).wipe("messages")
    store.wipe("memories")
    assert store.read("memories").count() == 0


def test_embedding_cache_and_vector_upsert(spark):
    def make():
        def client(texts):
            assert len(set(texts)) == len(texts)
            return [[float(len(t)), 1.0] for t in texts]

        return client

    t = spark.createDataFrame([("a", "xx"), ("b", "xx"), ("c", "yyy")], "id string, text string")
    cache = spark.createDataFrame([], "key string, vector array<float>")
    v, cache = embed_cached(t, cache, make, "m", 2)
    assert {r.id: list(r.vector) for r in v.collect()} == {"a": [2.0, 1.0], "b": [2.0, 1.0], "c": [3.0, 1.0]}
    _, cache = embed_cached(t, cache, lambda: (lambda texts: 1 / 0), "m", 2)
    assert cache.count() == 2
    index = spark.createDataFrame([], "point_id string, target string, scope_key string, memory_id string, vector array<float>")
    new = spark.createDataFrame([("s", "m1", [1.0])], "scope_key string, memory_id string, vector array<float>")
    index = upsert_vectors(upsert_vectors(index, new, "t"), new.withColumn("vector", F.array(F.lit(2.0).cast("float"))), "t")
    assert [list(r.vector) for r in index.collect()] == [[2.0]]
