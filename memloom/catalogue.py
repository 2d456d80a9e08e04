"""Named queries over the fixture tables, and the same things in SQL for an independent engine.

Times are given as microseconds, so that no engine's time type matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import scalars, text
from memloom.operators import decision, dense, evaluate, fusion, graph, history, lexical, lineage, memory, parsers, readout, retrieval, tense, threads
from memloom.plans import search
from memloom.sources import fixtures as fx
from memloom.stage import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_POLICY = history.WindowPolicy(soft=1500, hard=4000, chars=True)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _micros(c: str) -> Column:
    return F.unix_micros(c).alias(c)


# ---------------------------------------------------------------- SQL that several queries share

M = """m AS (SELECT conv_id || ':' || turn AS record_id, CAST(conv_id % 10 AS VARCHAR) AS user_id, CAST(conv_id AS VARCHAR) AS session_id, turn AS idx, role, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS occurred_at, conv_id * 4096 + turn AS seq, turn % 3 = 0 AS time_given FROM conversations)"""
NOISE = r"(role = 'system' OR regexp_replace(content, '^\s+|\s+$', '', 'g') = 'No response requested.' OR regexp_matches(content, '^\s*<task-notification>'))"
E = """e AS (SELECT CAST(conv_id AS VARCHAR) AS line_id, conv_id || ':' || ((turn - 1) // 2) AS parent, conv_id || ':' || turn AS child,
  CASE WHEN turn % 4 = 3 THEN 'part' ELSE 'after' END AS kind, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS known_at,
  CASE WHEN turn % 5 = 4 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id + 5) + to_minutes(turn) END AS retired_at FROM conversations WHERE turn > 0)"""
W = """w AS (SELECT user_id, min(seq) AS first_seq, (min(seq) + max(seq)) // 2 AS last_seq, CASE WHEN user_id IN ('3', '7') THEN 'compiled' ELSE 'done' END AS status FROM m GROUP BY user_id)"""
S = """s AS (SELECT conv_id || ':' || turn AS node_id, v, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id + v - 1) + to_minutes(turn) AS knowledge_at, role <> 'system' AS readable, turn % 7 <> 6 AS complete
  FROM conversations, (VALUES (1), (2)) AS t(v) WHERE v = 1 OR turn % 2 = 0)"""
Q = r"""q AS (SELECT CAST(item_id AS VARCHAR) AS question_id, CAST(item_id % 10 AS VARCHAR) AS scope, array_to_string(regexp_extract_all(text, '[^ \n\t]+')[1:8], ' ') AS text FROM benchmark)"""
U = """u AS (SELECT CAST(conv_id % 10 AS VARCHAR) AS scope, conv_id || ':' || turn AS id, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text AS text FROM conversations)"""
T0 = "TIMESTAMP '2024-01-03 12:00:00'"


def _cutoff() -> Column:
    return F.expr(T0)


def _tokens(c: str) -> str:
    return rf"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+')"


def _bm25(docs: str, asked: str, k: int, name: str = "r", k1: float = 1.5, b: float = 0.75, count_empty: bool = False) -> str:
    """CTEs that end in `name` (question_id, id, score, rank)."""
    p = name
    return f"""{p}d AS (SELECT scope, id, {_tokens('text')} AS t FROM {docs}),
{p}s AS (SELECT scope, count(*) AS n, avg(len(t)) AS mean FROM {p}d {'' if count_empty else 'WHERE len(t) > 0'} GROUP BY scope),
{p}f AS (SELECT scope, id, len(t) AS length, term, count(*) AS tf FROM (SELECT scope, id, t, unnest(t) AS term FROM {p}d) GROUP BY ALL),
{p}g AS (SELECT scope, term, count(*) AS df FROM {p}f GROUP BY ALL),
{p}q AS (SELECT DISTINCT question_id, scope, unnest({_tokens('text')}) AS term FROM {asked}),
{p}x AS (SELECT question_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {k1 + 1}) / (tf + {k1} * (1 - {b} + {b} * length / mean))), 6) AS score
  FROM {p}q JOIN {p}g USING (scope, term) JOIN {p}s USING (scope) JOIN {p}f USING (scope, term) GROUP BY question_id, id),
{p} AS (SELECT * FROM (SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM {p}x) WHERE rank <= {k})"""


# ---------------------------------------------------------------- texts and messages


@query(f"""WITH {M}, u AS (SELECT session_id, record_id, idx, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content AS text FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY session_id, text ORDER BY idx) AS k FROM u)
SELECT 'raw:' || session_id || ':' || (row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1) AS unit_id, record_id, length(text) AS n_chars FROM f WHERE k = 1""")
def units_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return history.split_units(fx.messages(spark, sf)).select("unit_id", "record_id", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(fx.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL")
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.lit("all").alias("scope"), F.col("doc_id").alias("id"), "text")
    return lexical.term_frequencies(d).select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"WITH {M} SELECT record_id FROM m WHERE NOT {NOISE}")
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fx.messages(spark, sf).where(~scalars.is_noise(F.col("role"), F.col("content"))).select("record_id")


@query(f"""WITH {M}, c AS (SELECT user_id, sum(len(regexp_extract_all(content, '[一-鿿]'))) AS cjk, sum(len(regexp_extract_all(content, '[A-Za-z]+'))) AS words FROM m WHERE role = 'user' GROUP BY user_id)
SELECT user_id, CASE WHEN cjk > 0 AND cjk >= words THEN 'zh' ELSE 'en' END AS language, CAST(words AS BIGINT) AS words FROM c""")
def person_language(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).where("role = 'user'").groupBy("user_id").agg(F.sum(scalars.count_cjk(F.col("content"))).alias("cjk"), F.sum(scalars.count_english(F.col("content"))).alias("words"))
    return m.select("user_id", scalars.speaks_chinese(F.col("cjk"), F.col("words")).alias("language"), "words")


@query(r"SELECT doc_id, CAST(floor((length(text) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))) / 4 + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / 1.5) AS BIGINT) AS n_tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", scalars.estimate_tokens(F.col("text")).alias("n_tokens"))


_STATED_TEXT = "'seen ' || strftime(ts, CASE WHEN event_id % 2 = 0 THEN '%Y-%m-%d' ELSE '%Y-%m-%d %H:%M' END) || ' and 2023-13-45, again 2024-01-10'"


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf)
    at = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
    return e.select("event_id", F.concat(F.lit("seen "), at, F.lit(" and 2023-13-45, again 2024-01-10")).alias("text"))


@query("SELECT event_id, CAST(2 AS BIGINT) AS n, least(epoch_us(CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END), epoch_us(TIMESTAMP '2024-01-10')) AS first_at FROM events")
def stated_times(spark: SparkSession, sf: str) -> DataFrame:
    t = _stated(spark, sf).withColumn("t", scalars.stated_times(F.col("text")))
    return t.select("event_id", F.size("t").cast("long").alias("n"), F.unix_micros(F.array_min("t")).alias("first_at"))


@query("SELECT event_id, greatest(epoch_us(CASE WHEN event_id % 2 = 0 THEN date_trunc('day', ts) + INTERVAL '23:59' HOUR TO MINUTE ELSE date_trunc('minute', ts) END), epoch_us(TIMESTAMP '2024-01-10 23:59:00')) AS end_at FROM events".replace("INTERVAL '23:59' HOUR TO MINUTE", "to_minutes(1439)"))
def stated_end(spark: SparkSession, sf: str) -> DataFrame:
    return _stated(spark, sf).select("event_id", F.unix_micros(scalars.stated_end(F.col("text"))).alias("end_at"))


@query(f"""WITH {M} SELECT record_id, '[Original message' || CASE WHEN time_given THEN ' | ' || strftime(occurred_at, '%Y-%m-%d %H:%M') ELSE '' END || '] ' || role || ': ' || content AS line FROM m""")
def rendered_sources(spark: SparkSession, sf: str) -> DataFrame:
    return fx.messages(spark, sf).select("record_id", scalars.render_source(F.col("role"), F.col("content"), F.col("occurred_at"), F.col("time_given")).alias("line"))


@query("SELECT item_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash FROM benchmark")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "benchmark").select("item_id", scalars.content_hash(F.col("text")).alias("content_hash"))


@query(r"""WITH r AS (SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)), 1) AS i FROM documents),
g AS (SELECT *, regexp_matches(line, '\S') AS solid, sum(CASE WHEN regexp_matches(line, '\S') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM r),
p AS (SELECT doc_id, part, any_value(text) AS text, string_agg(line, chr(10) ORDER BY i) AS paragraph FROM g WHERE solid GROUP BY doc_id, part),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM p)
SELECT doc_id, k, CAST(length(CASE WHEN c = 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE paragraph END) AS INTEGER) AS n_chars FROM n
UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '\S')""")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(text.paragraphs_udf("text")).alias("k", "paragraph")).select("doc_id", "k", F.length("paragraph").alias("n_chars"))


@query()
def anchor_span(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))
    b = fx.table(spark, sf, "benchmark").withColumn("w", words)
    first, last = F.array_join(F.slice("w", 1, 3), " "), F.array_join(F.slice("w", 6, 3), " ")
    return b.select("item_id", text.anchor_udf("text", F.upper(first), last).alias("span"))


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT *, 1 + conv_id % (n + 2) AS a, 1 + conv_id * 3 % (n + 2) AS b FROM c)
SELECT conv_id, coalesce(array_to_string(list_transform(range(least(a, b), least(greatest(a, b), n) + 1), lambda x: x - 1), ','), '') AS messages FROM r""")
def parse_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A turn range of its own for each conversation, over its messages by paragraphs; ranges may be reversed or reach past the end."""
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", text.paragraphs_udf("text").alias("p"))
    lists = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.size("p").alias("n")))), lambda x: x.n).alias("counts"))
    n = F.size("counts").cast("long")
    asked = F.concat(F.lit("M"), 1 + F.col("conv_id") % (n + 2), F.lit("-M"), 1 + F.col("conv_id") * 3 % (n + 2))
    return lists.select("conv_id", text.turns_udf(asked, "counts").alias("messages")).select("conv_id", F.array_join("messages", ",").alias("messages"))


# ---------------------------------------------------------------- history


@query(f"""WITH {M}, f AS (SELECT *, min(seq) OVER (PARTITION BY user_id, session_id) AS first FROM m)
SELECT record_id, dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS session_no, seq FROM f""")
def session_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return history.places(fx.messages(spark, sf)).select("record_id", F.col("session_no").cast("long").alias("session_no"), "seq")


@query(f"""WITH {M}, r AS (SELECT record_id, time_given, last_value(CASE WHEN time_given THEN occurred_at END IGNORE NULLS) OVER (PARTITION BY user_id, session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM m)
SELECT record_id, epoch_us(r) AS session_at FROM r WHERE NOT time_given AND r IS NOT NULL""")
def session_last_time(spark: SparkSession, sf: str) -> DataFrame:
    return history.session_times(fx.messages(spark, sf)).select("record_id", _micros("session_at"))


@query(f"""WITH {M} SELECT record_id, array_to_string(list(record_id) OVER (PARTITION BY user_id, session_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' ') AS context FROM m""".replace("array_to_string(list", "coalesce(array_to_string(list").replace(", ' ') AS", ", ' '), '') AS"))
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    return history.context_before(fx.messages(spark, sf), 3).select("record_id", F.array_join("context", " ").alias("context"))


@query(f"WITH {M}, {W} SELECT m.user_id, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS n FROM m JOIN w USING (user_id) WHERE seq > last_seq GROUP BY m.user_id")
def pending_size(spark: SparkSession, sf: str) -> DataFrame:
    return history.pending_size(fx.messages(spark, sf), fx.windows(spark, sf))


@query(f"WITH {M}, {W} SELECT m.user_id FROM m JOIN w USING (user_id) WHERE seq > last_seq UNION SELECT user_id FROM w WHERE status = 'compiled'")
def users_pending(spark: SparkSession, sf: str) -> DataFrame:
    return history.users_with_pending(fx.messages(spark, sf), fx.windows(spark, sf))


@query(f"WITH {M} SELECT record_id, CAST(coalesce(sum(length(content)) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM m")
def characters_before(spark: SparkSession, sf: str) -> DataFrame:
    return history.characters_before(fx.messages(spark, sf)).select("record_id", "chars_before")


@query(f"WITH {M} SELECT user_id, epoch_us(arg_max(occurred_at, seq)) AS now FROM m GROUP BY user_id")
def last_time(spark: SparkSession, sf: str) -> DataFrame:
    return history.last_time(fx.messages(spark, sf)).select("user_id", _micros("now"))


@query(f"WITH {M} SELECT session_id AS request_id, string_agg(record_id, ' ' ORDER BY idx) AS records FROM m GROUP BY session_id")
def request_groups(spark: SparkSession, sf: str) -> DataFrame:
    return history.by_request(fx.messages(spark, sf)).select("request_id", F.array_join(F.transform("messages", lambda x: x.record_id), " ").alias("records"))


_BREAKS = f"""b AS (SELECT *, coalesce(session_id <> lag(session_id) OVER u OR (time_given AND lag(time_given) OVER u AND epoch_us(occurred_at) - epoch_us(lag(occurred_at) OVER u) >= 7200000000)
  OR (role = 'user' AND lag(role) OVER u <> 'user'), false) AS breaks, CASE WHEN {NOISE} THEN 0 ELSE length(content) END AS size FROM m WINDOW u AS (PARTITION BY user_id ORDER BY seq))"""


@query(f"WITH {M}, {_BREAKS} SELECT record_id, breaks FROM b")
def break_flags(spark: SparkSession, sf: str) -> DataFrame:
    return history.break_flags(fx.messages(spark, sf), _POLICY).select("record_id", "breaks")


@query(f"WITH {M}, {_BREAKS} SELECT record_id, CAST(sum(size) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM b")
def prefix_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return history.prefix_sizes(fx.messages(spark, sf), _POLICY).select("record_id", "upto")


@query(f"""WITH RECURSIVE {M}, {_BREAKS},
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, sum(size) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto, count(*) OVER (PARTITION BY user_id) AS total FROM b),
c AS (
  SELECT a.user_id, a.i, a.upto - a.size AS base, a.total FROM n a),
x AS (
  SELECT c.user_id, c.i, c.total,
    min(e.i) FILTER (WHERE e.i < c.total AND e.upto - base <= 4000 AND e.upto - base >= 1500 AND f.breaks) AS broken,
    max(e.i) FILTER (WHERE e.upto - base <= 4000) AS fits, max(e.upto - base) AS all_size
  FROM c JOIN n e ON e.user_id = c.user_id AND e.i >= c.i LEFT JOIN n f ON f.user_id = e.user_id AND f.i = e.i + 1 GROUP BY c.user_id, c.i, c.total, c.base),
ends AS (SELECT user_id, i, total, coalesce(broken, CASE WHEN all_size >= 4000 THEN greatest(i, coalesce(fits, i)) ELSE total END) AS stop FROM x),
r AS (SELECT user_id, i, stop FROM ends WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.stop FROM r JOIN ends e ON e.user_id = r.user_id AND e.i = r.stop + 1)
SELECT r.user_id, a.seq AS first_seq, z.seq AS last_seq, r.stop - r.i + 1 AS n, CAST(z.upto - a.upto + a.size AS BIGINT) AS size
FROM r JOIN n a ON a.user_id = r.user_id AND a.i = r.i JOIN n z ON z.user_id = r.user_id AND z.i = r.stop""")
def window_cut(spark: SparkSession, sf: str) -> DataFrame:
    return history.cut_windows(fx.messages(spark, sf), _POLICY).select("user_id", "first_seq", "last_seq", "n", "size")


@query("""WITH f AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER u) >= 7200000000, true) AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM f)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended FROM g GROUP BY user_id, session_no""")
def event_gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return history.gap_sessions(fx.events(spark, sf), 120).select("user_id", "session_no", "n", _micros("started"), _micros("ended"))


@query("SELECT user_id, event_type AS question, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_active FROM events GROUP BY ALL")
def upsert_max(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf).select("user_id", F.col("event_type").alias("question"), F.col("ts").alias("at"))
    return history.touch_lines(e).select("user_id", "question", _micros("first_seen"), _micros("last_active"))


@query(f"WITH {M} SELECT user_id, 's' || session_id AS stretch_id, arg_max(content, seq) AS summary, count(*) AS n_members FROM m GROUP BY user_id, session_id")
def stretch_latest(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf).withColumn("stretch_id", F.concat(F.lit("s"), "session_id"))
    return m.groupBy("user_id", "stretch_id").agg(F.max_by("content", "seq").alias("summary"), F.count("*").alias("n_members"))


# ---------------------------------------------------------------- search


@query(f"WITH {U}, {Q}, {_bm25('u', 'q', 10)} SELECT question_id, id, score, rank FROM r")
def bm25_topk_user(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(fx.units(spark, sf), fx.questions(spark, sf), 10).withColumn("rank", F.col("rank").cast("long"))


_LANG_Q = Q.replace("CAST(item_id % 10 AS VARCHAR)", "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END")


@query(f"WITH d AS (SELECT lang AS scope, doc_id AS id, text FROM documents), {_LANG_Q}, {_bm25('d', 'q', 20)} SELECT question_id, id, score, rank FROM r")
def bm25_topk_scope(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("id"), "text")
    langs = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("question_id").cast("int") % 4 + 1))
    return lexical.bm25(d, fx.questions(spark, sf).withColumn("scope", langs), 20).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {U}, {Q}, {_bm25('u', 'q', 10, k1=1.2, count_empty=True)} SELECT question_id, id, score, rank FROM r WHERE score > 0")
def bm25_line_cards(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(fx.units(spark, sf), fx.questions(spark, sf), 10, k1=1.2, count_empty=True, positive_only=True).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH q AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS v FROM embeddings GROUP BY label),
s AS (SELECT CAST(q.label AS VARCHAR) AS question_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score FROM embeddings JOIN q USING (label))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.table(spark, sf, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dense.nearest(v, fx.label_questions(spark, sf), 10).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
a AS (SELECT label, i, avg(x) AS x FROM x GROUP BY label, i) SELECT label, round(sqrt(sum(x * x)), 6) AS norm FROM a GROUP BY label""")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    v = fx.table(spark, sf, "embeddings").select(F.col("label").alias("scope"), F.col("embedding").alias("vector"))
    return dense.centroids(v).select(F.col("scope").alias("label"), F.round(F.sqrt(scalars.dot(F.col("vector"), F.col("vector"))), 6).alias("norm"))


_RECENT = "h AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY seq DESC) AS rank FROM q JOIN (SELECT user_id AS scope, record_id AS id, seq FROM m) USING (scope) QUALIFY rank <= 50)"


def _recent(spark: SparkSession, sf: str, k: int = 50) -> DataFrame:
    m = fx.messages(spark, sf).select(F.col("user_id").alias("scope"), F.col("record_id").alias("id"), "seq")
    newest = m.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("seq")))).where(F.col("rank") <= k)
    return fx.questions(spark, sf).select("question_id", "scope").join(newest, "scope").select("question_id", "rank", "id")


@query(f"""WITH {M}, {U}, {Q}, {_bm25('u', 'q', 50)}, {_RECENT},
a AS (SELECT question_id, id, rank, 1.0 / (60 + rank) AS w, 0 AS i, 'bm25' AS arm FROM r UNION ALL SELECT question_id, id, rank, 0.5 / (60 + rank), 1, 'recent' FROM h),
f AS (SELECT question_id, id, round(sum(w), 9) AS score, min(rank) AS best_rank, string_agg(arm || ':' || id, '|' ORDER BY i) AS refs FROM a GROUP BY question_id, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best_rank, id) AS rank FROM f) WHERE rank <= 20""".replace("1.0 / (60 + rank) AS w", "CAST(1 AS DOUBLE) / (60 + rank) AS w").replace("0.5 / (60", "CAST(0.5 AS DOUBLE) / (60"))
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    lex = lexical.bm25(fx.units(spark, sf), fx.questions(spark, sf), 50).select("question_id", F.lit("bm25").alias("arm"), "rank", "id")
    hits = lex.unionByName(_recent(spark, sf).withColumn("arm", F.lit("recent")))
    out = fusion.fuse(hits, {"bm25": 1.0, "recent": 0.5}, 20)
    return out.withColumns({c: F.col(c).cast("long") for c in ("best_rank", "rank")})


@query(f"""WITH {M}, {U}, {Q}, {_bm25('u', 'q', 30)}, bd AS (SELECT user_id AS scope, 'sb:' || record_id AS id, content AS text FROM m WHERE NOT {NOISE}), {_bm25('bd', 'q', 30, name='k')},
o AS (SELECT 'sb:' || record_id AS block, record_id FROM m WHERE NOT {NOISE}),
x AS (SELECT question_id, block AS id, rank, 0 AS route FROM r JOIN o ON o.record_id = r.id UNION ALL SELECT question_id, id, rank, 1 FROM k),
f AS (SELECT question_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, min(route * 1000 + rank) AS seen FROM x GROUP BY question_id, id)
SELECT question_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS rank FROM f) WHERE rank <= 20""")
def rrf_upward(spark: SparkSession, sf: str) -> DataFrame:
    q, b = fx.questions(spark, sf), fx.blocks(spark, sf)
    raw = lexical.bm25(fx.units(spark, sf), q, 30).select("question_id", "rank", "id")
    own = lexical.bm25(b.select(F.col("user_id").alias("scope"), F.col("block_id").alias("id"), "text"), q, 30).select("question_id", "rank", "id")
    out = fusion.upward(raw, b.select("record_id", "block_id", F.lit(0).cast("long").alias("ord")), own, 20)
    return out.select("question_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {M}, {U}, {Q}, {_bm25('u', 'q', 20)}, {_RECENT},
o AS (SELECT question_id, id, rank FROM r WHERE CAST(question_id AS INT) % 2 = 1 OR rank <= 2),
p AS (SELECT question_id FROM o GROUP BY question_id HAVING count(DISTINCT id) >= 3),
y AS (SELECT question_id, id, rank FROM h WHERE question_id NOT IN (SELECT question_id FROM p)),
z AS (SELECT DISTINCT question_id FROM y),
a AS (SELECT * FROM o WHERE question_id IN (FROM z) UNION ALL SELECT * FROM y),
f AS (SELECT question_id, id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, min(rank) AS best FROM a GROUP BY question_id, id),
g AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, best, id) AS rank FROM f)
SELECT question_id, id, rank FROM g WHERE rank <= 10 UNION ALL SELECT question_id, id, rank FROM o WHERE question_id NOT IN (FROM z) AND rank <= 10""")
def rrf_hyde(spark: SparkSession, sf: str) -> DataFrame:
    o = lexical.bm25(fx.units(spark, sf), fx.questions(spark, sf), 20).where("CAST(question_id AS INT) % 2 = 1 OR rank <= 2").select("question_id", "rank", "id")
    return fusion.hyde_fallback(o, _recent(spark, sf), 10).select("question_id", "id", F.col("rank").cast("long").alias("rank"))


_DOCS = "d AS (SELECT lang AS scope, doc_id AS id, text AS content, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM documents)"


def _doc_hits(spark: SparkSession, sf: str, k: int) -> DataFrame:
    d = fx.documents(spark, sf).select(F.lit("all").alias("scope"), "id", F.col("content").alias("text"))
    return lexical.bm25(d, fx.questions(spark, sf).withColumn("scope", F.lit("all")), k).select("question_id", "rank", "id")


_DOC_HITS = "t AS (SELECT 'all' AS scope, doc_id AS id, text FROM documents), " + Q.replace("CAST(item_id % 10 AS VARCHAR)", "'all'") + ", " + _bm25("t", "q", 40)
_VALID = f"{_DOCS}, v AS (SELECT question_id, rank, id, content, length(content) AS n FROM r JOIN d USING (id) WHERE NOT bad AND scope = 'en')"


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.revalidate(_doc_hits(spark, sf, 40), fx.documents(spark, sf), fx.questions(spark, sf).withColumn("scope", F.lit("en")))


@query(f"WITH {_DOC_HITS}, {_VALID} SELECT question_id, rank, id FROM v")
def revalidate_join(spark: SparkSession, sf: str) -> DataFrame:
    return _valid(spark, sf).select("question_id", F.col("rank").cast("long").alias("rank"), "id")


@query(f"""WITH RECURSIVE {_DOC_HITS}, {_VALID},
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM v),
g AS (
  SELECT question_id, i, id, CAST(n <= 6000 AS INT) AS items, CASE WHEN n <= 6000 THEN 6000 - n ELSE 6000 END AS remaining, n <= 6000 AS taken FROM o WHERE i = 1
  UNION ALL SELECT o.question_id, o.i, o.id, g.items + CAST(o.n <= g.remaining AND g.items < 5 AS INT), CASE WHEN o.n <= g.remaining AND g.items < 5 THEN g.remaining - o.n ELSE g.remaining END, o.n <= g.remaining AND g.items < 5
  FROM g JOIN o ON o.question_id = g.question_id AND o.i = g.i + 1)
SELECT question_id, id FROM g WHERE taken""")
def greedy_budget(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.greedy_budget(_valid(spark, sf), 5, 6000).select("question_id", "id")


@query(f"WITH {_DOC_HITS}, {_VALID} SELECT question_id, id FROM (SELECT *, sum(n) OVER (PARTITION BY question_id ORDER BY rank) AS upto FROM v) WHERE upto <= 12000")
def prefix_budget(spark: SparkSession, sf: str) -> DataFrame:
    v = _valid(spark, sf).select("question_id", "rank", "id", F.length("content").alias("size"), F.lit(0).alias("cost"))
    return retrieval.prefix_budget(v, 12_000).select("question_id", "id")


@query(f"""WITH {_DOC_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY id % 3 = 0 DESC, rank DESC) AS out, count(*) OVER (PARTITION BY question_id) AS n FROM r)
SELECT question_id, id FROM o WHERE out > n - 30""")
def cap_evict(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.cap(_doc_hits(spark, sf, 40), 30, F.col("id") % 3 == 0).select("question_id", "id")


@query(f"""WITH {_DOC_HITS}, g AS (SELECT question_id, id FROM r WHERE rank % 2 = 0)
SELECT question_id, id FROM (SELECT r.question_id, r.id, row_number() OVER (PARTITION BY r.question_id ORDER BY rank) AS k FROM r ANTI JOIN g ON g.question_id = r.question_id AND g.id = r.id) WHERE k <= 10""")
def fill_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    pool = _doc_hits(spark, sf, 40).withColumnRenamed("id", "record_id")
    return retrieval.fill_uncovered(pool, pool.where("rank % 2 = 0"), 10).select("question_id", F.col("record_id").alias("id"))


# ---------------------------------------------------------------- lines


@query(f"WITH {E} SELECT DISTINCT line_id, parent, child FROM e WHERE known_at <= {T0} AND (retired_at IS NULL OR retired_at > {T0})")
def asof_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges_at(fx.edge_revisions(spark, sf), _cutoff())


@query(f"""WITH {E}, c AS (SELECT 'q' || (line_id % 3) AS question_id, line_id, TIMESTAMP '2024-01-02 00:00:00' + to_hours(line_id % 3 * 24) AS at0 FROM (SELECT DISTINCT CAST(line_id AS BIGINT) AS line_id FROM e))
SELECT DISTINCT question_id, e.line_id, parent, child FROM e JOIN c ON CAST(c.line_id AS VARCHAR) = e.line_id WHERE known_at <= at0 AND (retired_at IS NULL OR retired_at > at0)""")
def asof_edges_each(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line_id").cast("long")
    at = F.timestamp_micros(F.unix_micros(F.expr("TIMESTAMP '2024-01-02 00:00:00'")) + line % 3 * 86_400_000_000)
    cutoffs = fx.edges(spark, sf).select("line_id").distinct().select(F.concat(F.lit("q"), line % 3).alias("question_id"), "line_id", at.alias("at"))
    return graph.edges_at_each(fx.edge_revisions(spark, sf), cutoffs)


@query(f"WITH {S} SELECT node_id, node_id || '#' || arg_max(v, (knowledge_at, v)) AS state_id FROM s WHERE knowledge_at <= {T0} AND readable GROUP BY node_id")
def asof_state(spark: SparkSession, sf: str) -> DataFrame:
    return graph.state_at(fx.node_states(spark, sf), _cutoff()).select("node_id", "state_id")


_AT = f"a AS (SELECT DISTINCT line_id, parent, child FROM e WHERE known_at <= {T0} AND (retired_at IS NULL OR retired_at > {T0}))"
_VISIBLE = f"v AS (SELECT DISTINCT split_part(node_id, ':', 1) AS line_id, node_id FROM s WHERE knowledge_at <= {T0} AND readable)"


def _visible(spark: SparkSession, sf: str) -> DataFrame:
    return graph.visible_nodes(fx.nodes(spark, sf), fx.memberships(spark, sf), fx.node_states(spark, sf), _cutoff()).select("line_id", "node_id")


@query(f"""WITH {E}, {S}, {_AT}, {_VISIBLE} SELECT line_id, node_id FROM v WHERE node_id NOT IN (SELECT parent FROM a WHERE parent IN (SELECT node_id FROM v) AND child IN (SELECT node_id FROM v))""")
def frontier(spark: SparkSession, sf: str) -> DataFrame:
    return graph.frontier(_visible(spark, sf), graph.edges_at(fx.edge_revisions(spark, sf), _cutoff())).select("line_id", "node_id")


@query(f"WITH {E} SELECT DISTINCT parent, child FROM e WHERE kind = 'part' AND known_at <= {T0} AND (retired_at IS NULL OR retired_at > {T0})")
def related_kind(spark: SparkSession, sf: str) -> DataFrame:
    return graph.related(fx.edge_revisions(spark, sf), fx.edges(spark, sf), _cutoff(), "part").select("parent", "child")


_WALK = """, w AS (SELECT x AS start, y AS node, 1 AS depth FROM s0 UNION ALL SELECT w.start, s0.y, depth + 1 FROM w JOIN s0 ON s0.x = w.node)
SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY start, node"""


@query(f"WITH RECURSIVE {E}, s0 AS (SELECT child AS x, parent AS y FROM e){_WALK}")
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    starts = fx.nodes(spark, sf).select(F.col("node_id").alias("start"))
    return graph.ancestors(starts, fx.edges(spark, sf)).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH RECURSIVE {E}, s0 AS (SELECT parent AS x, child AS y FROM e){_WALK}")
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    starts = fx.nodes(spark, sf).select(F.col("node_id").alias("start"))
    return graph.descendants(starts, fx.edges(spark, sf)).withColumn("depth", F.col("depth").cast("long"))


_ANCHORS = "k AS (SELECT CAST(conv_id % 5 AS VARCHAR) AS question_id, conv_id || ':' || turn AS node FROM conversations WHERE turn = 3)"


def _anchors(spark: SparkSession, sf: str, where: str = "turn = 3") -> DataFrame:
    c = fx.table(spark, sf, "conversations").where(where)
    return c.select((F.col("conv_id") % 5).cast("string").alias("question_id"), F.concat_ws(":", "conv_id", "turn").alias("node"))


@query(f"""WITH RECURSIVE {E}, {_ANCHORS}, b AS (SELECT parent AS x, child AS y FROM e UNION SELECT child, parent FROM e),
w AS (SELECT question_id, node, 0 AS d FROM k UNION SELECT question_id, y, d + 1 FROM w JOIN b ON b.x = w.node WHERE d < 2)
SELECT DISTINCT question_id, node FROM w WHERE (question_id, node) NOT IN (SELECT (question_id, node) FROM k)""".replace("(question_id, node) NOT IN (SELECT (question_id, node) FROM k)", "NOT EXISTS (FROM k WHERE k.question_id = w.question_id AND k.node = w.node)"))
def near(spark: SparkSession, sf: str) -> DataFrame:
    return graph.near(_anchors(spark, sf), fx.edges(spark, sf), 2)


@query(f"""WITH RECURSIVE {E}, k AS (SELECT CAST(conv_id % 5 AS VARCHAR) AS question_id, conv_id || ':' || turn AS node FROM conversations WHERE turn IN (0, 7)),
w AS (SELECT question_id, node AS at0, CAST([] AS VARCHAR[]) AS path, 0 AS d, false AS hit FROM k
  UNION ALL SELECT w.question_id, e.parent, CASE WHEN k.node IS NULL THEN list_append(w.path, e.parent) ELSE w.path END, d + 1, k.node IS NOT NULL
  FROM w JOIN e ON e.child = w.at0 LEFT JOIN k ON k.question_id = w.question_id AND k.node = e.parent WHERE NOT w.hit AND d <= 3)
SELECT DISTINCT question_id, unnest(path) AS node FROM w WHERE hit""")
def between(spark: SparkSession, sf: str) -> DataFrame:
    return graph.between(_anchors(spark, sf, "turn IN (0, 7)"), fx.edges(spark, sf), 3)


@query(f"""WITH RECURSIVE {E}, n AS (SELECT CAST(conv_id % 5 AS VARCHAR) AS question_id, conv_id || ':' || turn AS node FROM conversations WHERE turn <> 1),
b AS (SELECT x.question_id, x.node AS x, y.node AS y FROM n x JOIN e ON e.parent = x.node JOIN n y ON y.node = e.child AND y.question_id = x.question_id),
u AS (SELECT question_id, x, y FROM b UNION SELECT question_id, y, x FROM b),
w AS (SELECT question_id, node, node AS other FROM n UNION SELECT w.question_id, w.node, u.y FROM w JOIN u ON u.question_id = w.question_id AND u.x = w.other)
SELECT question_id, node, min(other) AS piece FROM w GROUP BY question_id, node""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(_anchors(spark, sf, "turn <> 1"), fx.edges(spark, sf))


@query(f"""WITH RECURSIVE {E}, {S}, {_AT}, {_VISIBLE}, i AS (SELECT parent, child FROM a WHERE parent IN (SELECT node_id FROM v) AND child IN (SELECT node_id FROM v)),
p AS (SELECT line_id, node_id AS head, node_id AS path FROM v WHERE node_id NOT IN (SELECT parent FROM i) UNION ALL SELECT p.line_id, i.parent, i.parent || ' > ' || p.path FROM p JOIN i ON i.child = p.head)
SELECT line_id, path FROM p WHERE head NOT IN (SELECT child FROM i)""")
def paths_to_frontier(spark: SparkSession, sf: str) -> DataFrame:
    p = graph.paths_to_frontier(_visible(spark, sf), graph.edges_at(fx.edge_revisions(spark, sf), _cutoff()))
    return p.select("line_id", F.array_join("path", " > ").alias("path"))


@query(f"""WITH RECURSIVE {E}, {S}, {_AT}, l AS (SELECT node_id, bool_or(complete) AS complete FROM s WHERE knowledge_at <= {T0} AND readable GROUP BY node_id),
w AS (SELECT node_id AS start, node_id AS node FROM l UNION SELECT w.start, a.parent FROM w JOIN l ON l.node_id = w.node JOIN a ON a.child = w.node)
SELECT start, string_agg(DISTINCT node, ' ' ORDER BY node) AS source_keys, bool_and(complete) AS complete FROM w JOIN l ON l.node_id = w.node GROUP BY start""")
def raw_closure(spark: SparkSession, sf: str) -> DataFrame:
    targets = _visible(spark, sf).select(F.col("node_id").alias("start"))
    c = graph.raw_closure(targets, graph.edges_at(fx.edge_revisions(spark, sf), _cutoff()), fx.memberships(spark, sf), fx.node_states(spark, sf), _cutoff())
    return c.select("start", F.array_join("source_keys", " ").alias("source_keys"), "complete")


@query(f"WITH {E} SELECT line_id, epoch_us(at0) AS at FROM (SELECT line_id, unnest([known_at, retired_at]) AS at0 FROM e) WHERE at0 >= {T0} UNION SELECT line_id, epoch_us({T0}) FROM e".replace("AS at FROM", 'AS "at" FROM'))
def change_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return graph.boundaries(fx.edge_revisions(spark, sf), _cutoff()).select("line_id", _micros("at"))


@query(f"WITH {E} SELECT child, CASE WHEN child LIKE '%:2' AND (retired_at IS NULL OR retired_at > {T0}) THEN epoch_us({T0}) ELSE epoch_us(retired_at) END AS retired_at FROM e")
def retire_edges(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.edge_revisions(spark, sf)
    gone = r.where("child LIKE '%:2'").select("line_id", "parent", "child", _cutoff().alias("at"))
    return graph.retire(r, gone, ["line_id", "parent", "child"]).select("child", _micros("retired_at"))


@query()
def dag_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's edges in order, then their reverses and shortcuts past a step, which must be refused."""
    c = fx.edges(spark, sf).withColumn("n", F.split("child", ":")[1].cast("long"))
    skip = c.join(c.select(F.col("child").alias("parent"), F.col("parent").alias("top")), "parent").select("line_id", F.col("top").alias("parent"), "child", "kind", (F.col("n") + 200).alias("ord"))
    events = c.select("line_id", "parent", "child", "kind", F.col("n").alias("ord")).unionByName(c.select("line_id", F.col("child").alias("parent"), F.col("parent").alias("child"), "kind", (F.col("n") + 100).alias("ord"))).unionByName(skip)
    return graph.insert_edges(events.withColumn("action", F.lit("add")).withColumn("at", _cutoff())).groupBy("line_id", "outcome").agg(F.count("*").alias("n"))


@query(r"""WITH b AS (SELECT conv_id || ':' || turn AS memory_id, turn, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS t0 FROM conversations),
s AS (SELECT *, turn % 3 <> 0 AS happened, turn % 3 = 0 AND turn % 2 = 1 AS settled, CASE WHEN turn % 4 = 2 THEN TIMESTAMP '2024-01-02 23:59:00' END AS stated FROM b)
SELECT memory_id, CASE WHEN happened OR (settled AND t0 + to_hours(1) <= TIMESTAMP '2024-01-03 12:00:00') OR stated IS NOT NULL THEN 'happened' ELSE 'in progress' END AS side,
  happened OR (settled AND t0 + to_hours(1) <= TIMESTAMP '2024-01-03 12:00:00') AS confirmed FROM s""")
def tense_side(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("memory_id"), "turn", fx.said_at(F.col("conv_id"), F.col("turn")).alias("t0"))
    blocks_ = c.select("memory_id", F.when(F.col("turn") % 4 == 2, "by 2024-01-02").otherwise("").alias("content"))
    said = c.select("memory_id", (F.col("turn") % 3 != 0).alias("happened"), F.col("t0").alias("known_at"))
    settled = c.where("turn % 3 = 0 AND turn % 2 = 1").select("memory_id", F.timestamp_micros(F.unix_micros("t0") + 3_600_000_000).alias("settled_at"), F.lit("x").alias("by_memory_id"))
    return tense.sides(blocks_, said, settled, _cutoff()).select("memory_id", "side", "confirmed")


@query(f"WITH {M} SELECT session_id AS memory_id, string_agg(record_id, ' ' ORDER BY occurred_at, record_id) AS by FROM m WHERE role = 'user' AND occurred_at <= {T0} GROUP BY session_id".replace("AS by", 'AS "by"'))
def settled_by(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.messages(spark, sf).where("role = 'user'").select(F.col("session_id").alias("memory_id"), F.col("occurred_at").alias("settled_at"), F.col("record_id").alias("by_memory_id"))
    return tense.settled_by(s, _cutoff()).select("memory_id", F.array_join("by", " ").alias("by"))


# ---------------------------------------------------------------- memories


def _memories(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.documents(spark, sf)
    at = F.timestamp_micros(F.unix_micros(F.expr(fx.START)) + F.col("id") * 60_000_000)
    return d.select(
        F.concat(F.lit("d"), "id").alias("memory_id"), F.col("scope").alias("scope_key"), "content", F.array(F.concat(F.lit("s"), F.col("id") % 50)).alias("source_keys"),
        F.lit(None).cast("string").alias("observation_id"), F.array(F.concat(F.lit("e"), F.col("id") % 7)).alias("evidence_refs"), at.alias("occurred_at"), at.alias("committed_at"), "lifecycle",
    )


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents")
    return d.select(F.col("lang").alias("scope_key"), F.concat(F.lit("s"), F.col("doc_id") % 50).alias("source_key"), F.concat(F.lit("v"), F.col("doc_id") % 3).alias("version_key"), F.concat(F.lit("d"), "doc_id").alias("memory_id"))


@query("""SELECT 'd' || doc_id AS memory_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
AND ((doc_id % 50 = 7 AND lang = 'en' AND doc_id % 3 <> 1) OR (doc_id % 50 = 8 AND lang = 'en'))""")
def invalidate_source(spark: SparkSession, sf: str) -> DataFrame:
    refs = spark.createDataFrame([("en", "s7", "v1", False), ("en", "s8", "v0", True)], "scope_key string, source_key string, version_key string, deleted boolean").withColumn("at", _cutoff())
    return memory.stale_memories(_memories(spark, sf), _sources(spark, sf), refs).select("memory_id")


@query("""WITH c AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM documents)
SELECT 'd' || doc_id AS memory_id, CASE WHEN bad THEN 'invalidated' WHEN doc_id % 10 = 0 THEN 'superseded' ELSE 'active' END AS lifecycle FROM c""")
def lifecycle_update(spark: SparkSession, sf: str) -> DataFrame:
    m = _memories(spark, sf)
    changed = m.where("CAST(substr(memory_id, 2) AS LONG) % 10 = 0").select("memory_id", F.lit("superseded").alias("lifecycle"), _cutoff().alias("at"))
    none = spark.createDataFrame([], "memory_id string, lifecycle string, transitioned_at timestamp")
    return memory.set_lifecycle(m, none, changed)[0].select("memory_id", "lifecycle")


@query("""WITH RECURSIVE l AS (SELECT conv_id || ':' || turn AS a, conv_id || ':' || (turn + 1) AS b FROM conversations WHERE (conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM conversations)),
w AS (SELECT a AS start, b AS node, 1 AS steps FROM l UNION ALL SELECT w.start, l.b, steps + 1 FROM w JOIN l ON l.a = w.node)
SELECT start AS memory_id, arg_max(node, steps) AS head, CAST(max(steps) AS BIGINT) AS steps FROM w GROUP BY start""".replace("(conv_id, turn + 1) IN (SELECT (conv_id, turn) FROM conversations)", "EXISTS (FROM conversations d WHERE d.conv_id = conversations.conv_id AND d.turn = conversations.turn + 1)"))
def supersede_chain(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    links = c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("memory_id"), F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("superseded_by"))
    return memory.supersede_chain(links).select("memory_id", "head", F.col("steps").cast("long").alias("steps"))


@query("""WITH t AS (SELECT 'd' || doc_id AS memory_id, target FROM documents, (VALUES ('dense'), ('graph')) AS x(target)),
i AS (SELECT 'projection-' || sha256('["' || memory_id || '","' || target || '"]') AS intent_id, memory_id, target FROM t) SELECT * FROM i WHERE target = 'dense' ORDER BY intent_id LIMIT 50""")
def queue_poll(spark: SparkSession, sf: str) -> DataFrame:
    from memloom import schemas

    targets = spark.createDataFrame([("dense",), ("graph",)], "target string")
    q = memory.enqueue(spark.createDataFrame([], schemas.of("projection_queue")), _memories(spark, sf), targets)
    return memory.poll(q, 50, "dense").select("intent_id", "memory_id", "target")


@query("""SELECT 'd' || doc_id AS memory_id, CASE WHEN toxic THEN 0 ELSE round(5 * (1 + ln(1 + doc_id % 5)) * exp(-0.03 * greatest(0, (epoch_us(TIMESTAMP '2024-01-03 12:00:00') - epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id))) / 86400000000.0)) * CASE WHEN doc_id % 4 = 0 THEN 0.25 ELSE 1 END, 6) END AS score
FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM documents)""".replace("THEN 0 ELSE", "THEN CAST(0 AS DOUBLE) ELSE").replace("86400000000.0", "CAST(86400000000 AS DOUBLE)").replace("-0.03 *", "CAST(-0.03 AS DOUBLE) *").replace("0.25 ELSE 1 END", "CAST(0.25 AS DOUBLE) ELSE 1 END"))
def attention_score(spark: SparkSession, sf: str) -> DataFrame:
    m = _memories(spark, sf)
    n = F.substr("memory_id", F.lit(2)).cast("long")
    a = m.select("memory_id", F.lit(5).alias("importance"), (n % 5).cast("int").alias("activation_count"), F.lit(None).cast("timestamp").alias("last_reinforced_at"), (n % 4 == 0).alias("resolved"), F.lit(False).alias("digested"), F.lit(False).alias("dont_surface"))
    return threads.attention(m, a, _cutoff(), "automatic").select("memory_id", "score")


@query("""WITH t AS (SELECT user_id, event_type, count(*) AS touches, max(ts) AS updated_at FROM events GROUP BY ALL),
s AS (SELECT CAST(user_id % 10 AS VARCHAR) AS scope_key, user_id || ':' || event_type AS thread_id, updated_at, round(5 * (1 + ln(1 + touches)) * exp(CAST(-0.01 AS DOUBLE) * greatest(0, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(updated_at)) / CAST(86400000000 AS DOUBLE))), 9) AS score FROM t)
SELECT scope_key, thread_id, score FROM (SELECT *, row_number() OVER (PARTITION BY scope_key ORDER BY score DESC, updated_at DESC, thread_id DESC) AS place FROM s) WHERE place <= 5""")
def thread_score(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.events(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").alias("touch_count"), F.max("ts").alias("updated_at"))
    t = e.select(
        F.concat_ws(":", "user_id", "event_type").alias("thread_id"), (F.col("user_id") % 10).cast("string").alias("scope_key"), F.lit("open").alias("status"), F.lit(5).alias("importance"),
        "updated_at", "touch_count", F.lit(False).alias("suppressed"), F.array(F.concat(F.lit("m"), F.col("user_id") % 10)).alias("current_support_ids"),
    )
    m = t.select(F.concat(F.lit("m"), "scope_key").alias("memory_id"), "scope_key").distinct().withColumn("lifecycle", F.lit("active"))
    return threads.surface_threads(t, m, F.expr("TIMESTAMP '2024-02-01 00:00:00'")).select("scope_key", "thread_id", "score")


@query(f"""WITH {Q}, d AS (SELECT doc_id, list_distinct({_tokens('text')}) AS t FROM documents WHERE doc_id % 10 < 10), x AS (SELECT question_id, list_distinct({_tokens('text')}) AS w FROM q),
s AS (SELECT question_id, doc_id, CASE WHEN least(len(w), len(t)) < 2 THEN CAST(0 AS DOUBLE) ELSE len(list_intersect(w, t)) / CAST(least(len(w), len(t)) AS DOUBLE) END AS score FROM x, d)
SELECT question_id, thread_id, round(score, 6) AS score FROM (SELECT question_id, CAST(doc_id AS VARCHAR) AS thread_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CAST(doc_id AS VARCHAR) DESC) AS place FROM s WHERE score >= 0.6) WHERE place = 1""")
def overlap_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each question matched to the document (as an open thread) that its words overlap most."""
    signals = fx.questions(spark, sf).select(F.col("question_id").alias("signal_id"), F.lit("all").alias("scope_key"), F.lit(None).cast("string").alias("question"), F.col("text").alias("summary"))
    t = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("thread_id"), F.lit("all").alias("scope_key"), F.lit("open").alias("status"), F.lit("").alias("open_question"), F.col("text").alias("working_summary"), F.lit(None).cast("string").alias("support_text"), _cutoff().alias("updated_at"))
    return threads.best_match(signals, t).select(F.col("signal_id").alias("question_id"), "thread_id", F.round("score", 6).alias("score"))


@query("""WITH l AS (SELECT 'u' || user_id AS region_id, event_type AS content, event_id, ts FROM events WHERE event_id % 3 = 0), a AS (SELECT region_id, content, min(ts) AS ts FROM l GROUP BY ALL)
SELECT 'u' || user_id AS region_id, event_type AS content, count(*) AS n FROM events ANTI JOIN a ON a.region_id = 'u' || user_id AND a.content = event_type GROUP BY ALL""")
def rejection_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of a user as proposals; those with an event_id divisible by 3 were rejected once."""
    from memloom import schemas

    e = fx.events(spark, sf).select(F.concat(F.lit("u"), "user_id").alias("region_id"), F.col("event_type").alias("content"), F.array(F.lit("s")).alias("source_refs"), "event_id", F.col("ts").alias("rejected_at"))
    denied = e.where("event_id % 3 = 0").withColumns({"authority_ref": F.lit("a"), "reason": F.lit(None).cast("string")})
    ledger = threads.reject(spark.createDataFrame([], schemas.of("rejections")), denied)
    return threads.not_rejected(e, ledger).groupBy("region_id", "content").agg(F.count("*").alias("n"))


@query(f"""WITH {M}, s AS (SELECT session_id AS question_id, record_id AS id, idx, (seq * 37 % 101) / CAST(100 AS DOUBLE) AS affirm, (seq * 53 % 101) / CAST(100 AS DOUBLE) AS deny FROM m WHERE role = 'user'),
t AS (SELECT question_id, count(*) AS n, arg_max(id, (affirm, -idx)) AS affirm_id, max(affirm) AS a, arg_max(id, (deny, -idx)) AS deny_id, max(deny) AS d FROM s GROUP BY question_id)
SELECT question_id, affirm_id, deny_id FROM t WHERE n >= 2 AND affirm_id <> deny_id AND a >= 0.5 AND d >= 0.5""")
def contradiction_note(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.messages(spark, sf)
    part = lambda k: (F.col("seq") * k % 101) / F.lit(100.0)
    return decision.contradictions(m.select(F.col("session_id").alias("question_id"), F.col("idx").alias("rank"), F.col("record_id").alias("id"), "role", part(37).alias("affirm"), part(53).alias("deny")))


@query(f"WITH {M} SELECT session_id AS region, count(*) AS revision, arg_max(content, seq) AS content FROM m WHERE role = 'user' GROUP BY session_id")
def lineage_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Each session as a lineage that every message of the person revises."""
    m = fx.messages(spark, sf).where("role = 'user'").select(F.col("session_id").alias("region"), F.col("seq").alias("ord"), "content", F.array("record_id").alias("support"), F.col("occurred_at").alias("at"))
    return lineage.heads(lineage.promote(spark.createDataFrame([], lineage.LINEAGE), m)).select("region", F.col("revision").cast("long").alias("revision"), "content")


@query("""WITH c AS (SELECT conv_id, CAST(conv_id % 10 AS VARCHAR) AS u, conv_id || ':' || turn AS memory_id, turn, conv_id || ':' || ((turn - 1) // 2) AS up, conv_id || ':0' AS root FROM conversations),
l AS (SELECT *, 'line_' || sha256('line|' || u || '|' || root)[1:32] AS line_id FROM c)
SELECT memory_id, line_id, 'node_' || sha256('node|' || line_id || '|' || memory_id)[1:32] AS node_id,
  CASE WHEN turn > 0 THEN 'node_' || sha256('node|' || line_id || '|' || up)[1:32] END AS parent, CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN 'part' ELSE 'after' END AS kind FROM l""")
def placements(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as batches of blocks, each going on from turn (t - 1) div 2."""
    c = fx.table(spark, sf, "conversations")
    after = F.when(F.col("turn") > 0, F.concat(F.lit("b"), F.expr("(turn - 1) div 2 + 1")))
    p = c.select((F.col("conv_id") % 10).cast("string").alias("user_id"), F.col("conv_id").alias("batch"), (F.col("turn") + 1).alias("ord"), F.concat_ws(":", "conv_id", "turn").alias("memory_id"), after.alias("after"), (F.col("turn") % 4 == 3).alias("part"), F.lit(True).alias("happened"))
    none = spark.createDataFrame([], "node_id string, line_id string")
    return lineage.apply_placements(p, none).select("memory_id", "line_id", "node_id", "parent", "kind")


@query(f"""WITH {M}, s AS (SELECT user_id AS window_id, session_id AS stretch_id, max(seq) AS last_seq, (min(seq) * 31 % 97) / CAST(97 AS DOUBLE) AS cosine FROM m GROUP BY user_id, session_id),
k AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY last_seq DESC, stretch_id) AS late, row_number() OVER (PARTITION BY window_id ORDER BY cosine DESC, last_seq DESC, stretch_id) AS near FROM s)
SELECT window_id, stretch_id FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY CASE WHEN late <= 3 THEN 0 ELSE 1 END, CASE WHEN late <= 3 THEN late ELSE near END) AS place FROM k) WHERE place <= 8""")
def earlier_stretches(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.messages(spark, sf).groupBy(F.col("user_id").alias("window_id"), F.col("session_id").alias("stretch_id")).agg(F.max("seq").alias("last_seq"), (F.min("seq") * 31 % 97 / F.lit(97.0)).alias("cosine"))
    return lineage.earlier_stretches(s).select("window_id", "stretch_id")


# ---------------------------------------------------------------- evaluation and readout

_JUDGED = """j AS (SELECT 'A' AS arm, doc_id AS id, quality AS v, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM labels UNION ALL SELECT 'B', doc_id, 1 - toxic, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END FROM labels)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    l = fx.table(spark, sf, "labels")  # noqa: E741
    side = F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("category")
    row = lambda arm, v: l.select(F.lit(arm).alias("arm"), F.col("doc_id").cast("string").alias("id"), (v == 1).alias("is_correct"), F.lit(None).cast("double").alias("score"), side)
    return row("A", F.col("quality")).unionByName(row("B", 1 - F.col("toxic")))


@query(f"WITH {_JUDGED} SELECT arm, category, count(*) AS n, round(avg(v), 4) AS acc FROM j GROUP BY ALL")
def arm_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.accuracy(evaluate.aligned(_judged(spark, sf)))


@query()
def paired_diff(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.paired(_judged(spark, sf), "A", "B", rounds=200)


def _evidence(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Units, blocks, messages and edges of the conversations, as line_readout takes them."""
    m = fx.messages(spark, sf)
    places = history.places(m).select("record_id", "session_no")
    told = m.join(places, "record_id").select("record_id", "content", "role", "occurred_at", "time_given", "session_no", "seq")
    b = fx.blocks(spark, sf).join(places, "record_id")
    blocks = b.select("block_id", F.col("user_id").alias("scope"), "text", F.when(F.col("time_given"), F.col("occurred_at")).alias("occurred_at"), F.lit(True).alias("past"), "session_no", "seq", F.array("record_id").alias("sources"), F.concat(F.lit("s"), "session_id").alias("stretch_id"))
    e = fx.edges(spark, sf).select(F.concat(F.lit("sb:"), "parent").alias("parent"), F.concat(F.lit("sb:"), "child").alias("child"))
    return {"units": fx.units(spark, sf).withColumn("record_id", F.col("id")), "blocks": blocks, "messages": told, "edges": e}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence items for a table of questions: search, upward fusion, readout along the lines."""
    t = _evidence(spark, sf)
    return search.line_readout(fx.questions(spark, sf), t["units"], t["blocks"].drop("stretch_id"), t["messages"], t["edges"], readout.Policy(raw_fill=10))


@query()
def readout_items(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf).select("question_id", "place", "id", "kind", "content", "score")


_LETTERS = "etaoinshrdlucmfw"


def _letter_vectors(t: Column) -> Column:
    """A vector that needs no model: how often each of 16 letters stands in the text."""
    return F.array(*(((F.length(t) - F.length(F.translate(t, x, ""))).cast("double")) for x in _LETTERS))


_LETTERS_SQL = "[" + ", ".join(f"CAST(length(text) - length(replace(text, '{x}', '')) AS DOUBLE)" for x in _LETTERS) + "]"


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, conv_id || ':' || turn AS id FROM conversations), v AS (SELECT *, {_LETTERS_SQL} AS v FROM c),
q AS (SELECT conv_id, arg_min(v, turn) AS q FROM v GROUP BY conv_id),
p AS (SELECT h.conv_id, h.turn, b.id AS block_id, list_dot_product(q.q, b.v) AS d, sqrt(list_dot_product(q.q, q.q)) * sqrt(list_dot_product(b.v, b.v)) AS norm
  FROM v h JOIN v b ON b.conv_id = h.conv_id AND (b.turn = h.turn OR b.turn = h.turn + 1) JOIN q ON q.conv_id = h.conv_id)
SELECT CAST(conv_id AS VARCHAR) AS question_id, CAST(turn + 1 AS BIGINT) AS rank, block_id AS id FROM p
QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN norm > 0 THEN d / norm ELSE 0 END DESC, block_id) = 1""")
def closest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of a message and the one before it; each message's block nearest its conversation's first message."""
    c = fx.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("question_id"), "turn", F.coalesce("text", F.lit("")).alias("text"), F.concat_ws(":", "conv_id", "turn").alias("id"))
    v = c.withColumn("vector", _letter_vectors(F.col("text")))
    blocks = v.select(F.col("id").alias("block_id"), F.array("id", F.concat_ws(":", "question_id", F.col("turn") - 1)).alias("sources"))
    vectors = v.groupBy("question_id").agg(F.min_by("vector", "turn").alias("vector")), v.select(F.col("id").alias("block_id"), "vector")
    return readout.closest_blocks(c.select("question_id", (F.col("turn") + 1).cast("long").alias("rank"), "id"), blocks, vectors)


@query()
def readout_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The readout with all it can take: stretches (a session each), standing steps, vectors, passages (the whole item) and languages."""
    t = _evidence(spark, sf)
    asked = fx.questions(spark, sf)
    passages = fx.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), (F.col("item_id") % 10).cast("string").alias("scope"), "text")
    stretches = t["blocks"].groupBy("stretch_id").agg(F.max_by("text", "seq").alias("summary"), F.array_sort(F.collect_list("block_id")).alias("members"))
    standing = t["blocks"].groupBy("scope").agg(F.min_by("block_id", "seq").alias("block_id"))
    languages = asked.select("question_id", F.when(F.col("question_id").cast("long") % 5 == 0, "zh").otherwise("en").alias("lang"))
    vectors = asked.select("question_id", _letter_vectors(F.col("text")).alias("vector")), t["blocks"].select("block_id", _letter_vectors(F.col("text")).alias("vector"))
    policy = readout.Policy(raw_fill=10, hit_anchors=True, thread_k=2, thread_span=True, forget_scope=True)
    out = search.line_readout(asked, t["units"], t["blocks"].drop("stretch_id"), t["messages"], t["edges"], policy, standing=standing, stretches=stretches, vectors=vectors, passages=passages, languages=languages)
    return out.select("question_id", "place", "id", "kind", "content", "score")


@query()
def compile_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers written from the conversations (a block a message), read back as blocks."""
    c = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("rows"))

    def blocks(rows) -> int:
        roles = [r["role"] for r in rows]
        answer = [{"turns": f"M{i}", "text": "said", "status": "confirmed"} for i in range(1, len(roles) + 1)]
        return len(parsers.chat_blocks(answer, roles))

    return c.select("conv_id", F.udf(blocks, "int")("rows").alias("n_blocks"))


from memloom import catalogue_logs, catalogue_tables  # noqa: E402, F401  (register their queries here)
