"""From ranked hits to what a question gets: revalidation, reranking, budgets, caps, exact selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def revalidate(hits: DataFrame, memories: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits whose memory is active and in the question's scope; the first of a memory's hits, with its rank.

    hits: question_id, rank, id; memories: id, scope, lifecycle, content; questions: question_id, scope.
    """
    valid = hits.join(questions.select("question_id", "scope"), "question_id").join(memories.where("lifecycle = 'active'").select("id", "scope", "content"), ["id", "scope"])
    first = F.row_number().over(Window.partitionBy("question_id", "id").orderBy("rank"))
    return valid.withColumn("__n", first).where("__n = 1").drop("__n")


def rerank(candidates: DataFrame, order: DataFrame) -> DataFrame:
    """candidates (question_id, id, rank, ...) ranked by order (question_id, id, place); a question whose order is incomplete, or that has under two candidates, keeps its ranks."""
    n = candidates.groupBy("question_id").agg(F.count("*").alias("n"))
    named = candidates.select("question_id", "id").join(order, ["question_id", "id"]).groupBy("question_id").agg(F.count_distinct("id").alias("named"))
    whole = n.join(named, "question_id", "left").select("question_id", ((F.col("n") >= 2) & (F.coalesce("named", F.lit(0)) == F.col("n"))).alias("whole"))
    first = order.groupBy("question_id", "id").agg(F.min("place").alias("place"))
    both = candidates.join(whole, "question_id").join(first, ["question_id", "id"], "left")
    by = F.when(F.col("whole"), F.col("place")).otherwise(F.col("rank"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(by, "rank"))).drop("whole", "place")


def greedy_budget(candidates: DataFrame, max_items: int, max_characters: int) -> DataFrame:
    """Candidates (question_id, id, rank, content) that fit: one that doesn't is skipped and the next is tried, until max_items.

    The choice depends on order, so it is a fold over each question's bounded candidate list.
    """
    if not max_items or not max_characters:
        return candidates.limit(0)
    item = F.struct("rank", "id", F.length("content").alias("size"))
    lists = candidates.groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("list"))
    kind = lists.schema["list"].dataType.elementType["id"].dataType.simpleString()
    start = F.struct(F.lit(max_characters).alias("left"), F.expr(f"CAST(array() AS array<{kind}>)").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = (x["size"] <= acc["left"]) & (F.size(acc["ids"]) < max_items)
        return F.struct(F.when(fits, acc["left"] - x["size"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["ids"], F.array(x["id"]))).otherwise(acc["ids"]).alias("ids"))

    taken = lists.select("question_id", F.explode(F.aggregate("list", start, step, lambda a: a["ids"])).alias("id"))
    return candidates.join(taken, ["question_id", "id"], "left_semi")


def prefix_budget(items: DataFrame, max_characters: int, max_tokens: int = 0) -> DataFrame:
    """items (question_id, rank, size, cost) up to the first that breaks a budget; max_tokens 0: characters alone."""
    upto = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    over = (F.sum("size").over(upto) > max_characters) | (F.lit(max_tokens > 0) & (F.sum("cost").over(upto) > max_tokens))
    return items.withColumn("over", over).where("NOT over").drop("over")


def readout_budget(items: DataFrame, readout_tokens: int) -> DataFrame:
    """Two passes: what isn't carried is measured, and carried items get what it leaves (at least one token's worth of budget).

    items: question_id, rank, size, cost, carried (boolean).
    """
    used = items.where("NOT carried").groupBy("question_id").agg(F.sum("cost").alias("used"))
    left = items.where("carried").join(used, "question_id", "left").withColumn("budget", F.greatest(F.lit(1), F.lit(readout_tokens) - F.coalesce("used", F.lit(0))))
    upto = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = left.withColumn("sum", F.sum("cost").over(upto)).where("sum <= budget").drop("used", "budget", "sum")
    return items.where("NOT carried").unionByName(kept)


def cap(items: DataFrame, limit: int, evict: Column) -> DataFrame:
    """At most `limit` items (question_id, rank, ...): those that `evict` names go first, the farthest of them first; then the tail."""
    n = F.count("*").over(Window.partitionBy("question_id"))
    order = Window.partitionBy("question_id").orderBy(F.desc(evict), F.desc("rank"))
    return items.withColumn("__n", n).withColumn("__out", F.row_number().over(order)).where(F.col("__out") > F.col("__n") - limit).drop("__n", "__out")


def select_exact(memories: DataFrame, wanted: DataFrame, max_items: int, active_only: bool = True) -> DataFrame:
    """The memories that wanted (scope, pos, id) names, in its order; raises if one is missing, repeated, inactive or of another scope, or if there are too many."""
    m = memories.where("lifecycle = 'active'") if active_only else memories
    found = wanted.join(m, ["id", "scope"], "left")
    bad = wanted.groupBy("id").count().where("count > 1").limit(1).count() or found.where("content IS NULL").limit(1).count() or wanted.limit(max_items + 1).count() > max_items
    if bad:
        raise ValueError("selection refused: every id must be named once, exist, be active and in scope")
    return found.orderBy("pos")


def support_order(support: DataFrame, limit: int, by_time: bool = False) -> DataFrame:
    """Each parent's supports (parent, id, query_rank, occurred_at): by query rank, newest, id; cut to limit; by_time: the kept ones in time order."""
    first = Window.partitionBy("parent").orderBy(F.coalesce("query_rank", F.lit(10**9)), F.desc_nulls_last("occurred_at"), "id")
    kept = support.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)
    if by_time:
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.asc_nulls_first("occurred_at"), "id")))
    return kept


def select_projections(candidates: DataFrame, limit: int, window: int, min_cosine: float) -> DataFrame:
    """Projections (question_id, id, best_rank, cosine) that qualify by a support's rank or by their own text; both routes first, then rank, cosine, id."""
    rank, near = F.coalesce("best_rank", F.lit(10**9)), F.coalesce("cosine", F.lit(0.0))
    by_support, by_text = rank <= window, F.col("cosine").isNotNull() & (near >= min_cosine)
    ok = candidates.where(by_support | by_text)
    order = Window.partitionBy("question_id").orderBy(F.when(by_support & by_text, 0).otherwise(1), rank, F.desc(near), "id")
    return ok.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("score", 1 / (60 + F.least(rank, F.lit(10**6))))


def fill_uncovered(pool: DataFrame, given: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of each question's pool (question_id, rank, record_id) that given (question_id, record_id) lacks."""
    left = pool.join(given.select("question_id", "record_id").distinct(), ["question_id", "record_id"], "left_anti")
    return left.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("place") <= limit)
