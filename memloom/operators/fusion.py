"""Reciprocal rank fusion and its variants, for tables of ranked hits.

Ranked hits: question_id, arm, rank (from 1), id, and optionally ref.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def candidate_limit(limit: int, multiplier: int = 4) -> int:
    """How many hits an arm is asked for when `limit` fused ones are wanted."""
    return min(100, max(limit, limit * multiplier))


def _once(hits: DataFrame) -> DataFrame:
    """An id counts once per arm, at its first rank; later ranks keep their place."""
    first = Window.partitionBy("question_id", "arm", "id").orderBy("rank")
    return hits.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _ranked(scores: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= limit)


def fuse(hits: DataFrame, weights: Mapping[str, float], limit: int, rrf_k: int = RRF_K) -> DataFrame:
    """(question_id, id, score, best_rank, refs, rank): sum of weight/(rrf_k + rank), ties to the best rank, then the id.

    refs names arm and ref of every hit, arms in the order of `weights`.
    """
    if len(weights) < 2:
        raise ValueError("fusion needs at least two arms")
    if min(weights.values()) <= 0 or rrf_k < 1:
        raise ValueError("weights and rrf_k must be positive")
    arms = list(weights)
    items = [x for a in arms for x in (F.lit(a), F.struct(F.lit(float(weights[a])).alias("w"), F.lit(arms.index(a)).alias("i")))]
    arm = F.element_at(F.create_map(*items), F.col("arm"))
    ref = F.coalesce(F.col("ref"), F.col("id").cast("string")) if "ref" in hits.columns else F.col("id").cast("string")
    own = _once(hits.where(F.col("arm").isin(*arms))).withColumn("a", arm)
    scores = own.groupBy("question_id", "id").agg(
        F.round(F.sum(F.col("a.w") / (rrf_k + F.col("rank"))), 9).alias("score"),
        F.min("rank").alias("best_rank"),
        F.array_sort(F.collect_list(F.struct(F.col("a.i").alias("i"), F.concat("arm", F.lit(":"), ref).alias("r")))).alias("refs"),
    )
    refs = F.array_join(F.transform("refs", lambda r: r.r), "|")
    return _ranked(scores.withColumn("refs", refs), limit, "best_rank", "id")


def upward(raw_hits: DataFrame, blocks_of: DataFrame, block_hits: DataFrame, limit: int, rrf_k: int = RRF_K, closest: DataFrame | None = None) -> DataFrame:
    """(question_id, id, score, rank) of blocks, from hits on raw records and hits on blocks.

    raw_hits: question_id, rank, id (record); blocks_of: record_id, block_id, ord; block_hits: question_id, rank, id.
    A record's rank goes to all its blocks, or with closest (question_id, block_id, relevance) to the most relevant.
    Ties go to what appears first: through the records in their order, then through the block hits; then to the smaller id.
    """
    reached = raw_hits.select("question_id", "rank", F.col("id").alias("record_id")).join(blocks_of, "record_id")
    all_reached = reached.select("question_id", F.struct(F.lit(0).alias("route"), F.col("rank").alias("rank"), F.col("ord").alias("ord")).alias("seen"), F.col("block_id").alias("id"), "rank")
    if closest is not None:
        best = Window.partitionBy("question_id", "record_id").orderBy(F.desc(F.coalesce("relevance", F.lit(0.0))), "ord", "block_id")
        reached = reached.join(closest, ["question_id", "block_id"], "left").withColumn("__n", F.row_number().over(best)).where("__n = 1")
    route_raw = reached.select("question_id", F.col("block_id").alias("id"), "rank")
    route_block = block_hits.select("question_id", "id", "rank")
    scores = route_raw.unionByName(route_block).groupBy("question_id", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"))
    by_block = block_hits.select("question_id", F.struct(F.lit(1).alias("route"), F.col("rank").alias("rank"), F.lit(0).cast("long").alias("ord")).alias("seen"), "id")
    seen = all_reached.select("question_id", F.struct(F.col("seen.route").alias("route"), F.col("seen.rank").alias("rank"), F.col("seen.ord").cast("long").alias("ord")).alias("seen"), "id").unionByName(by_block)
    first = seen.groupBy("question_id", "id").agg(F.min("seen").alias("seen"))
    return _ranked(scores.join(first, ["question_id", "id"]), limit, "seen", "id").drop("seen")


def hyde_fallback(original: DataFrame, hypothetical: DataFrame, limit: int, least: int = 3, rrf_k: int = RRF_K) -> DataFrame:
    """Questions with fewer than min(limit, least) distinct hits are fused with their hypothetical passage's hits; others stay.

    original, hypothetical: question_id, rank, id. A question without hypothetical hits keeps its original ones.
    """
    enough = original.groupBy("question_id").agg((F.count_distinct("id") >= min(limit, least)).alias("enough"))
    asked = hypothetical.join(enough, "question_id", "left").where(~F.coalesce("enough", F.lit(False)))
    helped = asked.select("question_id").distinct().withColumn("helped", F.lit(True))
    marked = original.join(helped, "question_id", "left")
    alone = marked.where("helped IS NULL").where(F.col("rank") <= limit).select("question_id", "id", F.lit(None).cast("double").alias("score"), "rank")
    arms = marked.where("helped").select("question_id", F.lit("original").alias("arm"), "rank", "id").unionByName(asked.select("question_id", F.lit("hyde").alias("arm"), "rank", "id"))
    return alone.unionByName(fuse(arms, {"original": 1.0, "hyde": 1.0}, limit, rrf_k).select("question_id", "id", "score", "rank"))


def hyde_augmented(original: DataFrame, hypothetical: DataFrame, limit: int, rrf_k: int = RRF_K) -> DataFrame:
    """Both hit lists are always fused."""
    arms = original.select("question_id", F.lit("original").alias("arm"), "rank", "id").unionByName(hypothetical.select("question_id", F.lit("hyde").alias("arm"), "rank", "id"))
    return fuse(arms, {"original": 1.0, "hyde": 1.0}, limit, rrf_k).select("question_id", "id", "score", "rank")


def fuse_records(lists: DataFrame, limit: int, rrf_k: int = RRF_K) -> DataFrame:
    """(question_id, id, score, rank) over lists (question_id, arm, rank, id): repeats within a list close up, ties go to what appears first, lists by name."""
    once = _once(lists)
    place = F.row_number().over(Window.partitionBy("question_id", "arm").orderBy("rank"))
    scores = once.withColumn("place", place).groupBy("question_id", "id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("place"))), 9).alias("score"), F.min(F.struct("arm", "place")).alias("first")
    )
    return _ranked(scores, limit, "first").drop("first")
