"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import chat_format, embedding_dedup, minhash_dedup, mixing, packing, secret_scan, substring_dedup, topk_search, toxicity, warc_revisit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(table(spark, sf_dir, "documents")))


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], chats.schema)
    return chat_format.summary(chat_format.render(chat_format.messages(chat_format.table_events(chats.unionByName(extra)))))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.summary(warc_revisit.resolve(warc_revisit.table_captures(table(spark, sf_dir, "pages"))))


def op7_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.deduplicate(table(spark, sf_dir, "documents"), percent=85)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(packing.pack(table(spark, sf_dir, "documents")))


def op10_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summary(substring_dedup.deduplicate(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mixing": op1_pfair_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_pivot_permutation": op3_pivot_permutation,
    "op4_counterfactual_toxicity": op4_counterfactual_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_histogram_topk": op7_histogram_topk,
    "op8_bayes_minhash": op8_bayes_minhash,
    "op9_harmonic_packing": op9_harmonic_packing,
    "op10_seed_extend": op10_seed_extend,
}

SQL: dict[str, str] = {
    "op5_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>') AS x,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>'), chr(10), '\n') AS r
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length(r) + length(x)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op3_pivot_permutation": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id""",
    "op7_histogram_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_seed_extend": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM t),
f AS (SELECT x, min(doc_id) AS lo FROM h GROUP BY x HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS p FROM h JOIN f USING (x) WHERE doc_id > lo),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
o AS (
  SELECT k.doc_id, count(g.p) AS n_removed, coalesce(string_agg(k.word, ' ' ORDER BY k.p) FILTER (WHERE g.p IS NULL), '') AS kept
  FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.p = k.p GROUP BY k.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(o.n_removed, 0) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM w LEFT JOIN o USING (doc_id)""",
    "op8_bayes_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op6_warc_revisits": r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, sha256(coalesce(html, '')) AS sha, regexp_replace(url, '#.*$', '') AS bare FROM pages),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '(:80|:443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))), '&') AS query
  FROM p),
k AS (
  SELECT page_id, tag, sha, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
  FROM u),
c AS (
  SELECT page_id * 8 + j AS record_id, canonical_url, page_id + j * 1000000000 AS "at", 'response' AS kind, j, CASE WHEN page_id % 5 <> 2 THEN tag || ':' || j END AS etag,
    CASE WHEN page_id % 6 <> 1 THEN 'day ' || j END AS last_modified, sha || ':' || j AS digest, CASE WHEN page_id % 2 = 0 THEN 'cache-control: no-store' || chr(10) ELSE '' END AS cache
  FROM k, range(2) AS t(j)
  UNION ALL
  SELECT page_id * 8 + 4 + i, canonical_url, page_id + i * 1000000000 - 500000000, 'revisit', i,
    CASE WHEN page_id % 5 = 2 THEN NULL WHEN page_id % 7 = 3 THEN 'x' || tag WHEN page_id % 4 = 1 THEN tag || ':' || (i - 2) ELSE tag || ':' || (i - 1) END,
    CASE WHEN page_id % 6 <> 1 THEN 'day ' || CASE WHEN (page_id + i) % 3 = 0 THEN i - 2 ELSE i - 1 END END, NULL, 'cache-control: max-age=' || i || chr(10)
  FROM k, range(3) AS t(i)),
r AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'etag': etag, 'last_modified': last_modified, 'digest': digest} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY "at", record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c),
s AS (
  SELECT *, coalesce(prior.etag = etag, prior.last_modified = last_modified) AS same FROM r),
t AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN prior IS NULL OR canonical_url IS NULL THEN 'orphan' WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'mismatch' END AS status FROM s)
SELECT record_id, canonical_url, kind, status, CASE WHEN status IN ('resolved', 'unverified') THEN prior.id END AS refers_to,
  CASE WHEN status = 'response' THEN digest WHEN status IN ('resolved', 'unverified') THEN prior.digest END AS digest,
  CASE WHEN status IN ('response', 'resolved', 'unverified') THEN cache || 'content-type: text/html' || chr(10) || 'date: ' || "at" END AS headers
FROM t""",
    "op1_pfair_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS src, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
b AS (SELECT greatest(1, CAST(ceil(count(*) / 2048) AS BIGINT)) AS rows, count(*) AS total FROM d),
c AS (
  SELECT src, count(*) AS n, greatest(CAST(round(1000 * sqrt(count(*) / CAST(any_value(total) AS DOUBLE))) AS BIGINT), 1) AS a,
    CAST(ceil(count(*) / any_value(b.rows)) AS BIGINT) AS blocks, row_number() OVER (ORDER BY src) AS i
  FROM d, b GROUP BY src),
e AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list({'i': i, 'a': a, 'rest': blocks, 'k': CAST(0 AS BIGINT), 'done': CAST(0 AS BIGINT)} ORDER BY i) AS s, CAST(sum(a) AS BIGINT) AS w,
    CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS block, CAST(sum(blocks) AS BIGINT) AS todo FROM c
  UNION ALL
  SELECT slot + 1, list_transform(s, lambda x: {'i': x.i, 'a': x.a, 'rest': x.rest - CAST(x.i = p AS BIGINT),
      'k': CASE WHEN s[p].rest = 1 THEN 0 ELSE x.k + CAST(x.i = p AS BIGINT) END, 'done': x.done + CAST(x.i = p AS BIGINT)}),
    CASE WHEN s[p].rest = 1 THEN w - s[p].a ELSE w END, CASE WHEN s[p].rest = 1 THEN 0 ELSE t + 1 END, p, s[p].done, todo - 1
  FROM (
    SELECT *, list_sort(list_transform(list_filter(s, lambda x: x.rest > 0 AND (x.k * w) // x.a <= t), lambda x: {'due': ((x.k + 1) * w + x.a - 1) // x.a, 'i': x.i}))[1].i AS p
    FROM e WHERE todo > 0)),
f AS (
  SELECT c.src, e.block, e.slot, e.block * b.rows AS first, sum(least(b.rows, c.n - e.block * b.rows)) OVER (ORDER BY e.slot ROWS UNBOUNDED PRECEDING) - least(b.rows, c.n - e.block * b.rows) AS start
  FROM e JOIN c ON c.i = e.pick, b WHERE e.slot >= 0),
r AS (
  SELECT d.*, row_number() OVER (PARTITION BY d.src ORDER BY CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(c.n / 2000) AS BIGINT), h, doc_id) - 1 AS rank FROM d JOIN c USING (src))
SELECT r.doc_id, r.source, f.block, f.slot, CAST(f.start + r.rank - f.first AS BIGINT) AS position FROM r, b JOIN f ON f.src = r.src AND f.block = r.rank // b.rows""",
}
