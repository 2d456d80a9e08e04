"""More named queries and their SQL: lookups, labels, lifecycles, jobs, budgets and orders over whole fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom import schemas
from memloom.catalogue import _RECENT, E, M, Q, T0, U, _bm25, _cutoff, _micros, _recent, query
from memloom.functions import scalars
from memloom.operators import evaluate, fusion, history, lexical, lineage, memory, readout, retrieval, threads
from memloom.plans import ingest
from memloom.sources import fixtures as fx
from memloom.sources import store
from memloom.streaming import windows as streams

# ---------------------------------------------------------------- lookups


@query(f"WITH {M} SELECT record_id, seq FROM m WHERE user_id = '3' AND seq BETWEEN 4096 * 10 AND 4096 * 600")
def raw_scan(spark: SparkSession, sf: str) -> DataFrame:
    return store.messages_where(fx.messages(spark, sf), user_id="3", first_seq=4096 * 10, last_seq=4096 * 600).select("record_id", "seq")


@query(f"WITH {M} SELECT record_id, fingerprint FROM (SELECT *, sha256(content) AS fingerprint FROM m) WHERE idx % 3 <> 1 AND idx % 4 <> 2")
def resolved_refs(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf)
    refs = m.select(F.when(F.col("idx") % 3 == 1, "other").otherwise("raw").alias("namespace"), "record_id", F.when(F.col("idx") % 4 == 2, "nobody").otherwise(F.col("user_id")).alias("user_id"), "session_id")
    gone = m.select(F.lit("raw").alias("namespace"), F.concat("record_id", F.lit("?")).alias("record_id"), "user_id", "session_id")
    return store.current_refs(refs.unionByName(gone), m, "raw").select("record_id", "fingerprint")


@query(f"WITH {M} SELECT 's' || user_id AS scope, CAST(idx AS INTEGER) AS pos, record_id AS id, content FROM m WHERE session_id = '4'")
def exact_selection(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).select(F.concat(F.lit("s"), "user_id").alias("scope"), F.col("record_id").alias("id"), "content", "session_id", F.col("idx").alias("pos"), F.lit("active").alias("lifecycle"))
    return retrieval.select_exact(m.select("scope", "id", "content", "lifecycle"), m.where("session_id = '4'").select("scope", "pos", "id"), 10_000).select("scope", "pos", "id", "content")


@query(f"WITH {M} SELECT record_id, CASE WHEN idx % 5 = 0 THEN idx % 2 = 0 WHEN idx % 5 = 1 THEN true ELSE false END AS time_given FROM m WHERE idx % 5 < 3")
def time_given_inferred(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).where("idx % 5 < 3").withColumn("request_id", F.col("record_id"))
    received = F.when(F.col("idx") % 5 == 1, F.timestamp_micros(F.unix_micros("occurred_at") + 1_000_000)).otherwise(F.timestamp_micros(F.unix_micros("occurred_at") + 999_999))
    known = m.withColumn("time_given", F.when(F.col("idx") % 5 == 0, F.col("idx") % 2 == 0))
    return history.backfill_time_given(known, m.select("request_id", received.alias("received_at"))).select("record_id", "time_given")


# ---------------------------------------------------------------- labels and identities


@query(f"""WITH {M}, f AS (SELECT *, min(seq) OVER (PARTITION BY user_id, session_id) AS first FROM m), p AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS no FROM f)
SELECT record_id, CASE WHEN time_given THEN strftime(occurred_at, '%Y-%m-%d %H:%M') || ' S' || no || ' #' || idx ELSE 'S' || no || ' #' || idx || ', session began ' || strftime(occurred_at + INTERVAL 90 MINUTE, '%Y-%m-%d') END AS label FROM p""")
def place_labels(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf)
    m = m.join(history.places(m).select("record_id", "session_no"), "record_id")
    at = F.when(F.col("time_given"), F.col("occurred_at"))
    began = F.timestamp_micros(F.unix_micros("occurred_at") + 90 * 60_000_000)
    return m.select("record_id", scalars.place_label(at, F.col("session_no"), F.col("idx"), began).alias("label"))


@query(f"WITH {M} SELECT record_id, CASE WHEN time_given THEN epoch_ms(occurred_at) * 1000 ELSE epoch_us({T0}) + idx END AS at FROM m")
def message_times(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf)
    millis = F.when(F.col("time_given"), F.unix_millis("occurred_at"))
    return m.select("record_id", F.unix_micros(scalars.message_time(millis, _cutoff(), F.col("idx"))).alias("at"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 10 = 0 THEN '[' || t || ' | original evidence unavailable] ' WHEN doc_id % 3 > 0 THEN '[' || t || '] ' WHEN doc_id % 10 = 0 THEN '[original evidence unavailable] ' ELSE '' END || text AS line
FROM (SELECT doc_id, coalesce(text, '') AS text, strftime({T0} + to_minutes(doc_id), '%Y-%m-%d %H:%M') AS t FROM documents)""")
def rendered_memories(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    at = F.timestamp_micros(F.unix_micros(_cutoff()) + F.col("doc_id") * 60_000_000)
    gone = F.when(F.col("doc_id") % 10 == 0, "invalidated").otherwise("active")
    return d.select("doc_id", scalars.render_memory(F.coalesce("text", F.lit("")), at, gone, F.col("doc_id") % 3 > 0).alias("line"))


@query(f"""WITH {M} SELECT record_id, '{{"domain":"' || CASE WHEN idx % 3 = 2 THEN 'world' ELSE 'user' END || '"' || CASE WHEN idx % 3 = 1 THEN '' ELSE ',"user_id":"' || user_id || '"' END || '}}' AS key, idx % 3 = 0 AS valid FROM m""")
def scope_keys(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("idx") % 3
    domain, user, none = F.when(kind == 2, "world").otherwise("user"), F.when(kind != 1, F.col("user_id")), F.lit(None).cast("string")
    return fx.messages(spark, sf).select("record_id", scalars.scope_key(domain, user_id=user).alias("key"), scalars.scope_is_valid(domain, user, none, none, none).alias("valid"))


@query("""SELECT doc_id, '[' || CASE doc_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' WHEN 2 THEN 'negated' ELSE 'unknown' END || CASE WHEN doc_id % 2 = 0 THEN '; day ' || doc_id ELSE '' END || ']' AS stamp FROM documents""")
def status_stamps(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (" Confirmed", "LIKELY", "negated ", "odd", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    when = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" day "), F.col("doc_id"))).otherwise(F.lit(" "))
    return fx.table(spark, sf, "documents").select("doc_id", scalars.status_stamp(status, when).alias("stamp"))


@query(r"SELECT item_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS key FROM benchmark")
def question_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "benchmark").select("item_id", scalars.question_key(F.col("text")).alias("key"))


@query("SELECT doc_id, row_number() OVER (ORDER BY 'p' || (doc_id % 3), doc_id) AS place FROM documents")
def local_orders(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id") % 3, F.lit("-"), F.col("doc_id")).alias("point"))
    return d.select("doc_id", F.row_number().over(Window.orderBy(scalars.local_order(F.col("point")))).cast("long").alias("place"))


@query(f"""WITH {M} SELECT record_id, 'mem_' || substr(sha256('{{"scope":"' || user_id || '","sources":["' || session_id || '","z"],"content":"k' || idx || '"}}'), 1, 32) AS memory_id FROM m""")
def memory_identities(spark: SparkSession, sf: str) -> DataFrame:
    sources = F.array(F.lit("z"), F.col("session_id"), F.lit("z"))
    return fx.messages(spark, sf).select("record_id", memory.memory_identity(F.col("user_id"), sources, F.concat(F.lit("k"), "idx")).alias("memory_id"))


# ---------------------------------------------------------------- memories and jobs


@query(f"""WITH {M}, c AS (SELECT session_id, min(occurred_at) AS first_at FROM m WHERE idx < 3 GROUP BY session_id)
SELECT session_id AS observation_id, epoch_us(first_at) AS occurred_at FROM c WHERE CAST(session_id AS BIGINT) % 5 > 0""")
def admitted(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).select(F.col("user_id").alias("scope_key"), F.col("record_id").alias("source_key"), "occurred_at", "session_id", "idx")
    own = m.where("idx < 3").groupBy("scope_key", F.col("session_id").alias("observation_id")).agg(F.collect_list("source_key").alias("source_keys"))
    broken = F.when(F.col("observation_id").cast("long") % 5 == 0, F.array(F.lit("gone"))).otherwise(F.expr("CAST(array() AS array<string>)"))
    candidates = own.withColumns({"source_keys": F.concat("source_keys", broken), "content": F.concat(F.lit("s"), "observation_id"), "evidence_refs": F.col("source_keys")})
    memories, _ = memory.admit(candidates, m.select("scope_key", "source_key", "occurred_at"), spark.createDataFrame([], schemas.of("memories")), _cutoff())
    return memories.select("observation_id", _micros("occurred_at"))


@query(f"WITH {M} SELECT record_id AS memory_id, idx FROM m")
def immutable_insert(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).select(F.col("record_id").alias("memory_id"), F.col("idx").cast("long").alias("idx"))
    return memory.insert(m.where("idx < 4"), m.where("idx > 1"))


@query(f"WITH {M}, s AS (SELECT record_id AS memory_id, session_id || ':' || (idx - 1) AS target, occurred_at FROM m WHERE idx % 3 = 1) SELECT target AS memory_id, 'superseded' AS lifecycle, epoch_us(occurred_at) AS at FROM s")
def supersede_changes(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).select(F.col("record_id").alias("memory_id"), F.col("user_id").alias("scope_key"), "session_id", "idx", F.col("occurred_at").alias("committed_at"))
    new = m.withColumn("supersedes", F.when(F.col("idx") % 3 == 1, F.concat_ws(":", "session_id", F.col("idx") - 1)))
    return memory.superseded(m, new).select("memory_id", "lifecycle", _micros("at"))


@query(f"WITH {M}, n AS (SELECT record_id AS memory_id, user_id AS scope_key, session_id || ':' || (idx + 1) AS support_id FROM m) SELECT n.* FROM n WHERE NOT EXISTS (FROM m WHERE m.record_id = n.support_id AND m.user_id = n.scope_key)")
def missing_support(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).select(F.col("record_id").alias("memory_id"), F.col("user_id").alias("scope_key"), F.concat_ws(":", "session_id", F.col("idx") + 1).alias("support_id"))
    return memory.missing_support(m, m)


@query(f"WITH {E}, i AS (SELECT conv_id || ':' || turn AS id FROM conversations WHERE turn = 1) SELECT DISTINCT id AS memory_id, parent, child FROM e JOIN i ON i.id = parent OR i.id = child")
def relations_of_ids(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.edges(spark, sf).select(F.col("parent").alias("from_memory_id"), F.col("child").alias("to_memory_id"))
    ids = fx.messages(spark, sf).where("idx = 1").select(F.col("record_id").alias("memory_id"))
    return memory.relations_of(r, ids).select("memory_id", F.col("from_memory_id").alias("parent"), F.col("to_memory_id").alias("child"))


@query(f"WITH {M}, {E}, r AS (SELECT parent AS id FROM e UNION ALL SELECT child FROM e), n AS (SELECT id, count(*) AS n FROM r GROUP BY id) SELECT record_id AS memory_id, CASE WHEN idx % 2 = 0 THEN 2 END AS n_members, coalesce(n, 0) AS n_relations FROM m LEFT JOIN n ON n.id = record_id")
def block_views(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf)
    meta = m.where("idx % 2 = 0").select(F.col("record_id").alias("memory_id"), F.array("role", "user_id").alias("members"))
    relations = fx.edges(spark, sf).select(F.col("parent").alias("from_memory_id"), F.col("child").alias("to_memory_id"), F.col("kind").alias("relation"))
    out = lineage.block_view(m.select(F.col("record_id").alias("memory_id")), meta, relations)
    return out.select("memory_id", F.when(F.col("members").isNotNull(), F.size("members")).alias("n_members"), F.size("relations").cast("long").alias("n_relations"))


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.messages(spark, sf).select(F.col("session_id").alias("source_key")).distinct()
    n = F.col("source_key").cast("long")
    jobs = s.select("source_key", F.lit(None).cast("string").alias("candidates"), F.lit(False).alias("done"))
    frozen = memory.freeze_jobs(jobs, s.where(n % 2 == 0).select("source_key", F.concat(F.lit("c"), "source_key").alias("candidates")))
    return memory.complete_jobs(frozen, s.where(n % 6 == 0))


@query("SELECT CAST(conv_id AS VARCHAR) AS source_key, CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id END AS candidates, conv_id % 6 = 0 AS done FROM conversations GROUP BY conv_id")
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    return _jobs(spark, sf)


@query("SELECT CAST(conv_id AS VARCHAR) AS source_key FROM conversations WHERE conv_id % 2 = 0 AND conv_id % 6 > 0 GROUP BY conv_id ORDER BY 1 LIMIT 32")
def recoverable_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return memory.recoverable(_jobs(spark, sf), 32).select("source_key")


@query("SELECT CAST(user_id AS VARCHAR) AS memory_id, CAST(count(*) AS INTEGER) AS activation_count, 5 AS importance, epoch_us(max(ts)) AS last FROM events GROUP BY user_id")
def reinforced(spark: SparkSession, sf: str) -> DataFrame:
    hits = fx.events(spark, sf).select(F.col("user_id").cast("string").alias("memory_id"), F.col("ts").alias("at"))
    return threads.reinforce(spark.createDataFrame([], schemas.of("attention")), hits).select("memory_id", "activation_count", "importance", F.unix_micros("last_reinforced_at").alias("last"))


@query("""WITH v AS (SELECT event_id AS ord, CAST(user_id % 10 AS VARCHAR) AS scope_key, user_id || ':' || event_type AS item_id, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 7 = 1 THEN 'accept' WHEN event_id % 7 = 2 THEN 'reject' ELSE 'put' END AS action FROM events),
c AS (SELECT scope_key, max(ord) AS cleared FROM v WHERE action = 'clear' GROUP BY scope_key),
l AS (SELECT item_id, scope_key, max(ord) AS ord, arg_max(action, ord) AS action FROM v WHERE action <> 'clear' GROUP BY item_id, scope_key)
SELECT item_id, scope_key, ord FROM l LEFT JOIN c USING (scope_key) WHERE action = 'put' AND (cleared IS NULL OR ord > cleared)""")
def pending_items(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    action = F.when(i % 97 == 0, "clear").when(i % 7 == 1, "accept").when(i % 7 == 2, "reject").otherwise("put")
    e = fx.events(spark, sf).select(i.alias("ord"), (F.col("user_id") % 10).cast("string").alias("scope_key"), F.concat_ws(":", "user_id", "event_type").alias("item_id"), F.lit("t").alias("turn_id"), action.alias("action"))
    return threads.pending_overlay(e).select("item_id", "scope_key", "ord")


@query(f"""WITH {M}, c AS (SELECT session_id AS signal_id, record_id AS memory_id, occurred_at FROM m WHERE idx % 5 < 4), n AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY occurred_at DESC, memory_id DESC) AS back FROM c)
SELECT signal_id, memory_id, row_number() OVER (PARTITION BY signal_id ORDER BY occurred_at, memory_id) AS place FROM n WHERE back <= 3""")
def supporting_memories(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).select(
        F.col("record_id").alias("memory_id"), F.col("user_id").alias("scope_key"), F.col("session_id").alias("observation_id"), F.array("record_id").alias("evidence_refs"), F.col("occurred_at").alias("committed_at"),
        F.when(F.col("idx") % 5 < 4, "active").otherwise("superseded").alias("lifecycle"),
    )
    refs = m.select(F.col("observation_id").alias("signal_id"), "scope_key", F.col("observation_id").alias("ref"))
    return threads.supporting(m, refs, 3).select("signal_id", "memory_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {M}, w AS (SELECT user_id || ':' || (idx % 4) AS window_id, user_id, min(seq) AS first_seq FROM m GROUP BY ALL)
SELECT window_id, CASE WHEN window_id LIKE '%:0' THEN 'old' ELSE 'new' END AS status FROM w""")
def window_journal(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).select(F.concat_ws(":", "user_id", F.col("idx") % 4).alias("window_id"), "user_id", F.col("seq").alias("first_seq"))
    old = m.where("window_id LIKE '%:0'").groupBy("window_id", "user_id").agg(F.min("first_seq").alias("first_seq")).withColumn("status", F.lit("old"))
    return ingest.journal(old, m.withColumn("status", F.lit("new"))).select("window_id", "status")


@query(f"WITH {M} SELECT user_id FROM m GROUP BY user_id HAVING sum(length(content)) > 2000 OR count(*) > 2 * 10")
def held_back_users(spark: SparkSession, sf: str) -> DataFrame:
    sizes = fx.messages(spark, sf).groupBy("user_id").agg(F.sum(F.length("content")).alias("chars"), F.count("*").alias("n"))
    return streams.over_limit(sizes, 2000, 10).select("user_id")


# ---------------------------------------------------------------- ranks, budgets, statistics


@query(f"""WITH {M}, {Q}, {_RECENT}, n AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM h)
SELECT question_id, id, CASE WHEN CAST(question_id AS BIGINT) % 2 = 0 AND n >= 2 THEN n + 1 - rank ELSE rank END AS rank FROM n""")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    hits = _recent(spark, sf)
    order = hits.select("question_id", "id", (-F.col("rank")).alias("place")).where((F.col("question_id").cast("long") % 2 == 0) | (F.col("place") < -1))
    return retrieval.rerank(hits, order).select("question_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {M}, i AS (SELECT user_id AS question_id, seq AS rank, length(content) // 4 AS cost, role = 'assistant' AS carried FROM m),
u AS (SELECT question_id, sum(cost) AS used FROM i WHERE NOT carried GROUP BY question_id),
s AS (SELECT i.*, greatest(1, 2000 - coalesce(used, 0)) AS budget, sum(cost) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM i LEFT JOIN u USING (question_id) WHERE carried)
SELECT question_id, rank, carried FROM i WHERE NOT carried UNION ALL SELECT question_id, rank, carried FROM s WHERE upto <= budget""")
def two_pass_budget(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf)
    items = m.select(F.col("user_id").alias("question_id"), F.col("seq").alias("rank"), F.length("content").alias("size"), F.floor(F.length("content") / 4).alias("cost"), (F.col("role") == "assistant").alias("carried"))
    return retrieval.readout_budget(items, 2000).select("question_id", "rank", "carried")


@query(f"""WITH {M}, s AS (SELECT session_id AS parent, record_id AS id, CASE WHEN idx % 3 > 0 THEN idx % 4 END AS query_rank, occurred_at FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY coalesce(query_rank, 1000000000), occurred_at DESC, id) AS n FROM s)
SELECT parent, id, row_number() OVER (PARTITION BY parent ORDER BY occurred_at, id) AS place FROM k WHERE n <= 4""")
def ordered_support(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.messages(spark, sf).select(F.col("session_id").alias("parent"), F.col("record_id").alias("id"), F.when(F.col("idx") % 3 > 0, F.col("idx") % 4).alias("query_rank"), "occurred_at")
    return retrieval.support_order(s, 4, by_time=True).select("parent", "id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {M}, c AS (SELECT user_id AS question_id, record_id AS id, CASE WHEN idx % 4 > 0 THEN seq % 50 END AS best_rank, CASE WHEN idx % 3 > 0 THEN CAST(seq % 101 AS DOUBLE) / 100 END AS cosine FROM m),
r AS (SELECT *, coalesce(best_rank, 1000000000) AS r, coalesce(cosine, 0) AS near FROM c), o AS (SELECT *, r <= 20 AS s, cosine IS NOT NULL AND near >= 0.6 AS t FROM r)
SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN s AND t THEN 0 ELSE 1 END, r, near DESC, id) AS place FROM o WHERE s OR t QUALIFY place <= 15""")
def selected_projections(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.messages(spark, sf).select(F.col("user_id").alias("question_id"), F.col("record_id").alias("id"), F.when(F.col("idx") % 4 > 0, F.col("seq") % 50).alias("best_rank"), F.when(F.col("idx") % 3 > 0, (F.col("seq") % 101).cast("double") / 100).alias("cosine"))
    return retrieval.select_projections(c, 15, 20, 0.6).select("question_id", "id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {M}, r AS (SELECT user_id AS question_id, session_id AS parent, CAST(session_id AS BIGINT) AS parent_rank, CASE WHEN idx = 0 THEN 'shared' ELSE record_id END AS source_key, occurred_at FROM m),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY question_id, source_key ORDER BY parent_rank, occurred_at) = 1)
SELECT question_id, parent, source_key, row_number() OVER (PARTITION BY question_id, parent ORDER BY occurred_at, source_key) AS place FROM o QUALIFY place <= 3""")
def source_item_lists(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.messages(spark, sf).select(F.col("user_id").alias("question_id"), F.col("session_id").alias("parent"), F.col("session_id").cast("long").alias("parent_rank"), F.when(F.col("idx") == 0, "shared").otherwise(F.col("record_id")).alias("source_key"), "occurred_at")
    return lineage.source_items(r, 3).select("question_id", "parent", "source_key", F.col("place").cast("long").alias("place"))


@query(f"""WITH {M}, {U}, {Q}, {_bm25('u', 'q', 30)}, {_RECENT},
a AS (SELECT question_id, id, rank FROM r UNION ALL SELECT question_id, id, rank FROM h),
f AS (SELECT question_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, min(rank) AS best_rank FROM a GROUP BY question_id, id)
SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best_rank, id) AS rank FROM f QUALIFY rank <= 20""")
def rrf_augmented(spark: SparkSession, sf: str) -> DataFrame:
    lex = lexical.bm25(fx.units(spark, sf), fx.questions(spark, sf), 30).select("question_id", "rank", "id")
    return fusion.hyde_augmented(_recent(spark, sf), lex, 20).withColumn("rank", F.col("rank").cast("long"))


@query(r"""WITH q AS (SELECT CAST(item_id AS VARCHAR) AS question_id, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS scope, text FROM benchmark), d AS (SELECT lang AS scope, doc_id AS id, text FROM documents), """ + _bm25("d", "q", 5) + " SELECT question_id, id, score, rank FROM r")
def bm25_whole_items(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark items as questions."""
    langs = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("item_id") % 4 + 1).cast("int"))
    asked = fx.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), langs.alias("scope"), "text")
    d = fx.table(spark, sf, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("id"), "text")
    return lexical.bm25(d, asked, 5).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT lang AS question_id, source AS kind, count(*) AS n FROM documents GROUP BY ALL")
def item_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return readout.counts_by_kind(fx.table(spark, sf, "documents").select(F.col("lang").alias("question_id"), F.col("source").alias("kind")))


@query("""WITH s AS (SELECT source AS question_id, lang, doc_id // 2 AS id, doc_id FROM documents),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id, id ORDER BY lang, doc_id) = 1)
SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY lang, doc_id, id) AS rank FROM o QUALIFY rank <= 40""")
def unified_sections(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("question_id"), F.col("lang").alias("section"), F.floor(F.col("doc_id") / 2).alias("id"), F.col("doc_id").alias("place"))
    return readout.unified(d, 40).select("question_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT lang AS arm, round(avg(doc_id % 7), 1) AS mean_items, round(avg(doc_id % 1000)) AS mean_tokens, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_truncated FROM documents GROUP BY lang")
def context_statistics(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    return evaluate.context_sizes(fx.table(spark, sf, "documents").select(F.col("lang").alias("arm"), (i % 7).alias("items"), (i % 1000).alias("approx_tokens"), (i % 3 == 0).alias("may_truncate")))


@query(f"WITH {E}, r AS (SELECT count(*) AS n_revisions, count(retired_at) AS n_retired FROM e), d AS (SELECT source AS scope_key, count(*) AS n_memories, count(*) FILTER (WHERE doc_id % 10 > 0) AS n_active FROM documents GROUP BY source) SELECT * FROM d, r")
def store_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("source").alias("scope_key"), F.when(F.col("doc_id") % 10 > 0, "active").otherwise("superseded").alias("lifecycle"))
    c = fx.table(spark, sf, "conversations").where("turn > 0")
    return evaluate.store_statistics(d, c.select(F.when(F.col("turn") % 5 == 4, _cutoff()).alias("retired_at")))


@query("""WITH l AS (SELECT user_id, event_type || ':' || (event_id % 40) AS question, min(ts) AS first_seen FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS user_id, question, row_number() OVER (PARTITION BY user_id ORDER BY first_seen DESC, question) AS n FROM l QUALIFY n <= 50""")
def newest_questions(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf).select("user_id", F.concat_ws(":", "event_type", F.col("event_id") % 40).alias("question"), F.col("ts").alias("at"))
    return history.questions(history.touch_lines(e)).select(F.col("user_id").cast("string").alias("user_id"), "question", F.col("n").cast("long").alias("n"))
