"""Search: a table of questions to ranked, budgeted evidence, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.fusion import candidate_limit, fuse, fuse_records, hyde_augmented, upward
from memloom.operators.lexical import bm25
from memloom.operators.readout import Policy, closeness, readout
from memloom.stage import materialize

MAX_QUERY, POOL = 4096, 200


def prepare_questions(questions: DataFrame, options_in_query: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of questions (question_id, user_id, query, top_k, options): `text` is the query, its options below it, at most 4096 characters; top_k is 1 to 100."""
    options = F.when(F.size(F.coalesce("options", F.expr("CAST(array() AS array<string>)"))) > 0, F.concat(F.lit("\n"), F.array_join("options", "\n"))).otherwise("")
    text = F.concat("query", options) if options_in_query else F.col("query")
    q = questions.withColumn("top_k", F.coalesce("top_k", F.lit(100))).withColumn("text", F.substr(text, F.lit(1), F.lit(MAX_QUERY)))
    ok = (F.trim(F.coalesce("query", F.lit(""))) != "") & (F.trim(F.coalesce("user_id", F.lit(""))) != "") & F.col("top_k").between(1, 100)
    return q.where(ok).select("question_id", F.col("user_id").alias("scope"), "text", "top_k"), q.where(~ok).select("question_id", F.lit("query, user_id or top_k is not valid").alias("error"))


def raw_search(units: DataFrame, questions: DataFrame, limit: int, dense: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """(question_id, rank, id): units by BM25, fused with dense hits (question_id, rank, id) where there are some."""
    most = max(limit, pool)
    lexical = bm25(units, questions, most).select("question_id", "rank", "id")
    if dense is None:
        return lexical.where(F.col("rank") <= limit)
    arms = lexical.withColumn("arm", F.lit("bm25")).unionByName(dense.where(F.col("rank") <= most).select("question_id", "rank", "id").withColumn("arm", F.lit("dense")))
    return fuse(arms, {"bm25": 1.0, "dense": 1.0}, limit).select("question_id", "rank", "id")


def records_of(hits: DataFrame, units: DataFrame, limit: int) -> DataFrame:
    """(question_id, rank, id): the records of unit hits, each once, in order. units: id, record_id."""
    own = hits.join(units.select("id", "record_id"), "id").select("question_id", F.lit("raw").alias("arm"), "rank", F.col("record_id").alias("id"))
    return fuse_records(own, limit).select("question_id", "rank", "id")


def line_readout(
    questions: DataFrame, units: DataFrame, blocks: DataFrame, messages: DataFrame, edges: DataFrame, policy: Policy = Policy(), top_k: int = 100, lang: str = "en", standing: DataFrame | None = None,
    stretches: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, passages: DataFrame | None = None, languages: DataFrame | None = None,
) -> DataFrame:
    """The flagship plan: raw hits and block hits, fused upward to blocks, read out along their lines.

    units: scope, id, record_id, text; blocks: block_id, scope, text, and what readout takes; messages, edges, stretches, vectors,
    languages: as in readout; standing: scope, block_id; passages: question_id, scope, text, hypothetical ones whose hits are fused
    with the question's own (a question without one, or with a blank one, is searched alone).
    """
    most = max(policy.raw_k, policy.raw_fill)
    pool = raw = materialize(records_of(raw_search(units, questions, most), units, most), "raw")
    own = blocks.select("scope", F.col("block_id").alias("id"), "text")
    limit = min(policy.sb_k, 100)
    if passages is None:
        block_hits = bm25(own, questions, limit).select("question_id", "rank", "id")
    else:
        asked = passages.where(F.trim(F.coalesce("text", F.lit(""))) != "")
        extra = records_of(raw_search(units, asked, policy.raw_k), units, policy.raw_k)
        lists = raw.where(F.col("rank") <= policy.raw_k).select("question_id", F.lit("0 question").alias("arm"), "rank", "id").unionByName(extra.select("question_id", F.lit("1 passage").alias("arm"), "rank", "id"))
        raw = materialize(fuse_records(lists, policy.raw_k).select("question_id", "rank", "id"), "raw_fused")
        deep = candidate_limit(limit)
        block_hits = hyde_augmented(bm25(own, questions, deep), bm25(own, asked, deep), limit).select("question_id", "rank", "id")
    heard = raw.where(F.col("rank") <= policy.raw_k)
    owners = blocks.select("block_id", F.posexplode("sources").alias("ord", "record_id")).select("record_id", "block_id", F.col("ord").cast("long").alias("ord"))
    reached = heard.select("question_id", F.col("id").alias("record_id")).join(owners, "record_id").select("question_id", "block_id").distinct()
    ranked = materialize(upward(heard, owners, block_hits, policy.sb_k, policy.rrf_k, closeness(reached, vectors)).select("question_id", "rank", "id"), "ranked")
    stands = None if standing is None else questions.select("question_id", "scope").join(standing.select("scope", F.col("block_id").alias("id")).distinct(), "scope").select("question_id", "id")
    return readout(ranked, raw, blocks, messages, edges, policy, lang, top_k, stands, stretches, vectors, pool, languages)
