"""The decision note: a contradiction, or an absence, among a question's hits. Scores come from an injected judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 0.5


def contradictions(scored: DataFrame, least: float = LEAST) -> DataFrame:
    """(question_id, affirm_id, deny_id): two different messages of the person that affirm and deny, each by `least` or more.

    scored: question_id, rank, id, role, affirm, deny. The highest score counts, ties go to the better rank; questions with one
    message of the person have none.
    """
    mine = scored.where("role = 'user'")
    best = lambda c: F.max_by("id", F.struct(F.col(c), -F.col("rank")))
    top = mine.groupBy("question_id").agg(F.count("*").alias("n"), best("affirm").alias("affirm_id"), F.max("affirm").alias("a"), best("deny").alias("deny_id"), F.max("deny").alias("d"))
    return top.where((F.col("n") >= 2) & (F.col("affirm_id") != F.col("deny_id")) & (F.col("a") >= least) & (F.col("d") >= least)).select("question_id", "affirm_id", "deny_id")


def judged_text(hits: DataFrame, most: int = 15_000, head: int = 500) -> DataFrame:
    """(question_id, messages): the heads of a question's hits in order, as a judge of absence reads them."""
    shown = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "content")
    rows = hits.withColumn("shown", F.substr(shown, F.lit(1), F.lit(head)))
    lists = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("l"))
    return lists.select("question_id", F.substr(F.array_join(F.transform("l", lambda x: x.shown), "\n\n"), F.lit(1), F.lit(most)).alias("messages"))


def first_hits(hits: DataFrame, most: int) -> DataFrame:
    """The first `most` hits of each question."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).where(F.col("__n") <= most).drop("__n")
