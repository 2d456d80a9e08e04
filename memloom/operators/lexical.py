"""BM25 over scoped texts, for a whole table of questions at once.

Only terms of the questions are looked up in the texts, so what is shuffled follows the
questions, not the corpus; lengths and counts come from one narrow aggregation per scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import tokens
from memloom.stage import spread

#: Question terms up to which the lookup is broadcast.
BROADCAST_TERMS = 100_000


def term_frequencies(docs: DataFrame, text_tokens: Column | None = None) -> DataFrame:
    """(scope, id, term, tf, length) of docs (scope, id, text)."""
    t = spread(docs.select("scope", "id", "text")).select("scope", "id", (tokens(F.col("text")) if text_tokens is None else text_tokens).alias("t"))
    each = t.select("scope", "id", F.size("t").alias("length"), F.explode("t").alias("term"))
    return each.groupBy("scope", "id", "term", "length").agg(F.count("*").alias("tf"))


def question_terms(questions: DataFrame, text_tokens: Column | None = None) -> DataFrame:
    """(question_id, scope, term), each term once."""
    t = tokens(F.col("text")) if text_tokens is None else text_tokens
    return questions.select("question_id", "scope", F.explode(F.array_distinct(t)).alias("term"))


def bm25(docs: DataFrame, questions: DataFrame, k: int | None, k1: float = 1.5, b: float = 0.75, count_empty: bool = False, positive_only: bool = False) -> DataFrame:
    """(question_id, id, score, rank): each question's k best texts of its scope (None: all that share a term), by score, then id.

    docs: scope, id, text; questions: question_id, scope, text. N, df and the mean length are per scope; texts without
    tokens don't count unless count_empty. Scores are rounded to 6 places before they are ranked.
    """
    if not k1 > 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b in [0, 1]")
    with_tokens = spread(docs.select("scope", "id", "text")).select("scope", "id", tokens(F.col("text")).alias("t"))
    lengths = with_tokens.select("scope", F.size("t").alias("length"))
    stats = (lengths if count_empty else lengths.where("length > 0")).groupBy("scope").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = question_terms(questions)
    wanted = asked.select("scope", "term").distinct()
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    found = with_tokens.select("scope", "id", F.size("t").alias("length"), F.explode("t").alias("term")).join(wanted, ["scope", "term"])
    tf = found.groupBy("scope", "id", "term", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("scope", "term").agg(F.count("*").alias("df"))
    weights = asked.join(df, ["scope", "term"]).join(stats, "scope")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.greatest("mean", F.lit(1e-9))))
    scores = weights.withColumn("idf", idf).join(tf, ["scope", "term"]).groupBy("question_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    if positive_only:
        scores = scores.where("score > 0")
    return top(scores, k)


def top(scores: DataFrame, k: int | None, by: str = "question_id") -> DataFrame:
    """The k best per question by score, ties to the smaller id, with their rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    ranked = scores.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)
