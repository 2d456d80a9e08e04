"""Named queries and their SQL for requests, thread and rejection logs, the projection queue, connectors and outlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom import schemas
from memloom.catalogue import E, M, T0, _cutoff, _micros, query
from memloom.operators import fusion, graph, lineage, memory, threads
from memloom.sources import fixtures as fx
from memloom.sources import requests, store


def _none(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schemas.of(table))


# ---------------------------------------------------------------- requests


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A request a message: whole texts or lists of parts, and by idx % 6 five kinds that are refused."""
    kind = F.col("idx") % 6
    role = F.when(kind != 5, F.col("role"))  # a null field isn't written
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text")))
    user = F.when(kind == 1, " ").otherwise(F.col("user_id")).alias("user_id")

    def body(content, wanted):
        sent = F.filter(F.array(F.struct(role.alias("role"), content.alias("content"), F.unix_millis("occurred_at").alias("timestamp"))), lambda m: wanted)
        return F.to_json(F.struct(F.col("record_id").alias("request_id"), user, "session_id", sent.alias("messages")))

    whole, split = body(F.col("content"), kind != 2), body(parts, kind != 2)
    own = F.when(kind == 3, F.concat(whole, F.lit("]"))).when(kind == 4, "[1]").when(F.col("seq") % 2 == 0, whole).otherwise(split)
    return fx.messages(spark, sf).select(own.alias("body"))


@query(f"WITH {M} SELECT record_id AS request_id, role, CASE WHEN seq % 2 = 0 THEN content WHEN content = '' THEN 'end' ELSE content || chr(10) || 'end' END AS content, epoch_ms(occurred_at) AS millis FROM m WHERE idx % 6 = 0")
def checked_requests(spark: SparkSession, sf: str) -> DataFrame:
    valid, _ = requests.check_requests(_bodies(spark, sf))
    return valid.select("request_id", F.explode("messages").alias("m")).select("request_id", "m.role", "m.content", "m.millis")


@query(f"""WITH {M} SELECT CASE idx % 6 WHEN 1 THEN 'user_id must be a nonempty string' WHEN 2 THEN 'messages must be a nonempty list' WHEN 3 THEN 'malformed JSON'
  WHEN 4 THEN 'JSON object required' ELSE 'each message needs a role' END AS error, count(*) AS n FROM m WHERE idx % 6 > 0 GROUP BY ALL""")
def refused_requests(spark: SparkSession, sf: str) -> DataFrame:
    _, refused = requests.check_requests(_bodies(spark, sf))
    return refused.groupBy("error").agg(F.count("*").alias("n"))


def _appended(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions as requests; every fourth comes twice, with another payload the second time."""
    m = fx.messages(spark, sf)
    said = F.struct("idx", "role", "content", F.when(F.col("time_given"), F.unix_millis("occurred_at")).alias("millis"))
    valid = m.groupBy("request_id", "user_id", "session_id").agg(F.array_sort(F.collect_list(said)).alias("said"))
    valid = valid.select("request_id", "user_id", "session_id", F.transform("said", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"), x.millis.alias("millis"))).alias("messages"), F.lit("a").alias("payload_hash"))
    again = valid.where("CAST(session_id AS BIGINT) % 4 = 0").withColumn("payload_hash", F.lit("b"))
    return requests.append_requests(valid.unionByName(again), _none(spark, "requests"), _none(spark, "messages"), _cutoff())


@query(f"""WITH {M}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS k FROM m)
SELECT session_id || ':' || k AS record_id, k AS place, time_given, CASE WHEN time_given THEN epoch_ms(occurred_at) * 1000 ELSE epoch_us({T0}) + k END AS at, sha256(content) AS fingerprint FROM o""")
def appended_messages(spark: SparkSession, sf: str) -> DataFrame:
    _, out, _ = _appended(spark, sf)
    place = F.col("seq") - F.min("seq").over(Window.partitionBy("request_id"))
    return out.select("record_id", place.alias("place"), "time_given", F.unix_micros("occurred_at").alias("at"), "fingerprint")


@query("SELECT 1 AS first, count(*) AS last, count(*) AS n FROM conversations")
def message_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The store's numbers have no gap and no repeat."""
    _, out, _ = _appended(spark, sf)
    return out.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("n")).withColumn("first", F.col("first").cast("int"))


@query("SELECT CAST(conv_id AS VARCHAR) AS request_id, 'b' AS payload_hash FROM conversations WHERE conv_id % 4 = 0 GROUP BY conv_id")
def request_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _appended(spark, sf)[2]


# ---------------------------------------------------------------- threads

_LOG = """r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
a AS (SELECT *, CASE WHEN n = 1 THEN 'open' WHEN event_id % 11 = 0 THEN 'resolve' WHEN event_id % 7 = 0 THEN 'suppress' ELSE 'update' END AS action FROM r),
c AS (SELECT user_id, min(event_id) AS closed FROM a WHERE action = 'resolve' GROUP BY user_id),
o AS (SELECT *, CASE WHEN action = 'open' THEN 'opened' WHEN action = 'suppress' OR closed IS NULL OR event_id <= closed THEN action ELSE 'refused' END AS outcome FROM a LEFT JOIN c USING (user_id))"""


def _threads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A thread a user: the first event opens it, others update, suppress or resolve it."""
    n, i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")), F.col("event_id")
    e = fx.events(spark, sf).select("user_id", "event_id").withColumn("n", n)
    action = F.when(F.col("n") == 1, "open").when(i % 11 == 0, "resolve").when(i % 7 == 0, "suppress").otherwise("update")
    log = e.select(
        F.concat(F.lit("u"), "user_id").alias("thread_id"), i.alias("ord"), action.alias("action"), F.lit("s").alias("scope_key"), F.lit("why?").alias("question"), F.lit(None).cast("string").alias("summary"),
        F.array(i.cast("string")).alias("support"), F.lit(False).alias("mature"), F.timestamp_micros(F.unix_micros(_cutoff()) + F.col("n").cast("long") * 60_000_000).alias("at"),
    )
    return threads.apply_thread_events(log, _none(spark, "threads"))


@query(f"WITH {_LOG} SELECT 'u' || user_id AS thread_id, event_id AS ord, outcome FROM o")
def thread_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _threads(spark, sf)[1]


@query(f"""WITH {_LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM o WHERE outcome IN ('opened', 'update', 'resolve')),
k AS (SELECT user_id, CAST(count(*) - 1 AS INTEGER) AS touch_count, max(CASE WHEN outcome = 'resolve' THEN 'resolved' ELSE 'open' END) AS status, string_agg(event_id, ' ' ORDER BY event_id) FILTER (WHERE back <= 8) AS support FROM s GROUP BY user_id),
h AS (SELECT user_id, bool_or(outcome = 'suppress') AS suppressed FROM o GROUP BY user_id)
SELECT 'u' || user_id AS thread_id, status, touch_count, suppressed, support FROM k JOIN h USING (user_id)""")
def thread_states(spark: SparkSession, sf: str) -> DataFrame:
    return _threads(spark, sf)[0].select("thread_id", "status", "touch_count", "suppressed", F.array_join("current_support_ids", " ").alias("support"))


@query(f"""WITH {M}, o AS (SELECT session_id, record_id, idx, CASE WHEN idx < 6 THEN idx ELSE 1000000 + idx END AS pos FROM m WHERE idx < 6 OR idx % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS back FROM o)
SELECT session_id, string_agg(record_id, ' ' ORDER BY pos) AS support FROM b WHERE back <= 4 GROUP BY session_id""")
def merged_support(spark: SparkSession, sf: str) -> DataFrame:
    ids = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("idx", "record_id")))), lambda x: x.record_id)
    both = fx.messages(spark, sf).groupBy("session_id").agg(ids(F.col("idx") < 6).alias("old"), ids(F.col("idx") % 2 == 0).alias("new"))
    return both.select("session_id", F.array_join(threads.merge_support(F.col("old"), F.col("new"), 4), " ").alias("support"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS memory_id, CASE WHEN user_id % 2 = 0 THEN 9 ELSE 5 END AS importance, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS activation_count, user_id % 2 = 0 AS resolved FROM u WHERE user_id % 2 = 0 OR user_id % 3 > 0""")
def changed_attention(spark: SparkSession, sf: str) -> DataFrame:
    u = fx.events(spark, sf).select("user_id").distinct()
    old = threads.reinforce(_none(spark, "attention"), u.where("user_id % 3 > 0").select(F.col("user_id").cast("string").alias("memory_id"), _cutoff().alias("at")))
    changes = u.where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("memory_id"), F.lit(9).alias("importance"), F.lit(True).alias("resolved"))
    return threads.set_attention(old, changes).select("memory_id", "importance", "activation_count", "resolved")


# ---------------------------------------------------------------- rejections


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    proposals = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("r"), i % 5).alias("region_id"), F.col("lang").alias("content"), F.array(F.concat(F.lit("s"), i % 3)).alias("source_refs"),
        F.timestamp_micros(F.unix_micros(_cutoff()) + i * 60_000_000).alias("rejected_at"), F.lit("a").alias("authority_ref"), F.lit("no").alias("reason"),
    )
    ledger = threads.reject(_none(spark, "rejections"), proposals)
    return threads.reopen(ledger, ledger.where("region_id = 'r0'").select("rejection_id", _cutoff().alias("reopened_at"), F.lit("b").alias("authority_ref")))


_LEDGER = f"l AS (SELECT 'r' || (doc_id % 5) AS region_id, lang AS content, 's' || (doc_id % 3) AS source, epoch_us({T0}) + min(doc_id) * 60000000 AS rejected_at FROM documents GROUP BY doc_id % 5, lang, doc_id % 3)"


@query(f"WITH {_LEDGER} SELECT region_id, content, source, rejected_at, region_id <> 'r0' AS active FROM l")
def rejection_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf).select("region_id", F.col("rejected_content").alias("content"), F.col("source_refs")[0].alias("source"), _micros("rejected_at"), F.col("reopened_at").isNull().alias("active"))


@query(f"WITH {_LEDGER} SELECT region_id, content, source FROM l WHERE region_id <> 'r0' AND (region_id = 'r1' OR source = 's2')")
def relevant_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return threads.relevant_rejections(_ledger(spark, sf), ["r0", "r1"], ["s2"]).select("region_id", F.col("rejected_content").alias("content"), F.col("source_refs")[0].alias("source"))


# ---------------------------------------------------------------- projections and vectors


@query(f"""WITH {M}, q AS (SELECT record_id AS memory_id, idx % 4 AS k, CASE WHEN idx % 3 = 1 THEN 1 ELSE 0 END AS generation FROM m)
SELECT memory_id, generation, CASE WHEN k = 3 THEN 0 ELSE 1 END AS attempts, CASE WHEN k = 1 THEN 'failed_retryable' WHEN k <> 3 AND generation = 0 THEN 'succeeded' ELSE 'pending' END AS status, CASE WHEN k = 1 THEN 'boom' END AS last_error FROM q""")
def projection_results(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).withColumnRenamed("record_id", "memory_id")
    queue = memory.enqueue(_none(spark, "projection_queue"), m, spark.createDataFrame([("t",)], "target string"))
    queue = memory.requeue(queue, m.where("idx % 3 = 1").select("memory_id"))
    done = queue.join(m.where("idx % 4 <> 3").select("memory_id", "idx"), "memory_id").select("intent_id", F.lit("ref").alias("provider_ref"), F.when(F.col("idx") % 4 == 1, "boom").alias("error"), F.lit(0).alias("expected_generation"))
    return memory.acknowledge(queue, done).select("memory_id", "generation", "attempts", "status", "last_error")


@query("SELECT CAST(vec_id AS VARCHAR) AS memory_id, sha256('t|' || vec_id) AS point_id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE CAST(len(embedding) AS INTEGER) END AS size FROM embeddings")
def upserted_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("scope_key"), F.col("vec_id").cast("string").alias("memory_id"), F.col("embedding").cast("array<float>").alias("vector"), "vec_id")
    index = store.upsert_vectors(_none(spark, "memory_vectors"), e.drop("vec_id"), "t")
    new = e.where("vec_id % 3 = 0").select("scope_key", "memory_id", F.array(F.lit(1.0).cast("float")).alias("vector"))
    return store.upsert_vectors(index, new, "t").select("memory_id", "point_id", F.size("vector").alias("size"))


def _lengths() -> Callable[[list[str]], list[list[float]]]:
    """A stand-in embedding client: a text's length."""
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


@query("SELECT item_id AS id, CASE WHEN text IN (SELECT text FROM benchmark WHERE item_id % 2 = 0) THEN -1.0 ELSE CAST(length(text) AS DOUBLE) END AS first FROM benchmark")
def cached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    known = b.where("id % 2 = 0").select(store.cache_key("m", 2, F.col("text")).alias("key"), F.expr("CAST(array(-1, 0) AS array<float>)").alias("vector")).distinct()
    vectors, _ = store.embed_cached(b, known, _lengths, "m", 2)
    return vectors.select("id", F.col("vector")[0].cast("double").alias("first"))


def _counting() -> Callable[[list[str]], list[str]]:
    """A stand-in model: says how long its prompt is."""
    return lambda prompts: [f"{len(p)} characters" for p in prompts]


@query("SELECT item_id, length(text) || ' characters' AS answer FROM benchmark")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    return store.with_model(fx.table(spark, sf, "benchmark").select("item_id", "text"), "text", "answer", _counting).select("item_id", "answer")


# ---------------------------------------------------------------- matters, outlines, fusion


@query(f"""WITH {M}, s AS (SELECT session_id, any_value(user_id) AS user_id, max(occurred_at) AS latest, string_agg(role, chr(10) ORDER BY idx) AS x, string_agg(k || '. ' || role, chr(10) ORDER BY idx) AS steps FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS k FROM m) GROUP BY session_id)
SELECT session_id, '[' || user_id || ' | last update ' || strftime(latest, '%Y-%m-%d %H:%M') || '] why?' || chr(10) || 'Steps in order:' || chr(10) || steps || CASE WHEN CAST(session_id AS BIGINT) % 2 = 0 THEN chr(10) || 'Current state: open' ELSE '' END AS matter FROM s""")
def matter_texts(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.messages(spark, sf).groupBy("session_id", "user_id").agg(F.max("occurred_at").alias("latest"), F.array_sort(F.collect_list(F.struct("idx", "role"))).alias("said"))
    state = F.when(F.col("session_id").cast("long") % 2 == 0, "open").otherwise("")
    return s.select("session_id", lineage.matter_text(F.col("user_id"), F.col("latest"), F.lit("why?"), F.transform("said", lambda x: x.role), state).alias("matter"))


@query(f"""WITH {M}, t AS (SELECT session_id AS thread_id, user_id AS region, max(occurred_at) AS mine FROM m WHERE idx < 3 GROUP BY ALL)
SELECT thread_id FROM t WHERE NOT coalesce(region < '5' AND {T0} >= mine, false)""")
def open_threads_behind(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).withColumnRenamed("record_id", "memory_id")
    t = m.where("idx < 3").groupBy(F.col("session_id").alias("thread_id"), F.col("user_id").alias("region")).agg(F.collect_list("memory_id").alias("support"))
    heads = m.select(F.col("user_id").alias("region")).distinct().where("region < '5'").withColumn("newest", _cutoff())
    return lineage.superseded_threads(t, heads, m).select("thread_id")


@query(f"""WITH RECURSIVE {E}, n AS (SELECT CAST(conv_id AS VARCHAR) AS line_id, conv_id || ':' || turn AS node, role FROM conversations),
p AS (SELECT line_id, child, min(parent) AS parent FROM e GROUP BY ALL),
t AS (SELECT line_id, node, [node] AS path FROM n WHERE node NOT IN (SELECT child FROM p) UNION ALL SELECT p.line_id, p.child, list_append(t.path, p.child) FROM t JOIN p ON p.parent = t.node)
SELECT t.line_id, row_number() OVER (PARTITION BY t.line_id ORDER BY path) AS place, CAST(len(path) - 1 AS INTEGER) AS depth, repeat('  ', len(path) - 1) || '- ' || role AS text FROM t JOIN n USING (node)""")
def outlines(spark: SparkSession, sf: str) -> DataFrame:
    labels = fx.messages(spark, sf).select(F.col("session_id").alias("line_id"), F.col("record_id").alias("node"), F.col("role").alias("label"))
    out = graph.tree_report(fx.edges(spark, sf), labels)
    return out.select("line_id", F.col("place").cast("long").alias("place"), F.col("depth").cast("int").alias("depth"), "text")


@query(f"""WITH {M}, f AS (SELECT user_id AS question_id, role AS arm, session_id AS id, min(seq) AS seq FROM m GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id, arm ORDER BY seq) AS place FROM f),
s AS (SELECT question_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + place)), 9) AS score, min(struct_pack(arm := arm, place := place)) AS first FROM p GROUP BY question_id, id)
SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first) AS rank FROM s QUALIFY rank <= 20""")
def fused_records(spark: SparkSession, sf: str) -> DataFrame:
    lists = fx.messages(spark, sf).select(F.col("user_id").alias("question_id"), F.col("role").alias("arm"), F.col("seq").alias("rank"), F.col("session_id").alias("id"))
    return fusion.fuse_records(lists, 20).select("question_id", "id", "score", F.col("rank").cast("long").alias("rank"))
