"""Exact nearest neighbours by cosine within a scope, for a table of questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.scalars import cosine, vector_is_valid
from memloom.operators.lexical import top

#: Question vectors up to this many bytes are broadcast; beyond, scopes are joined.
BROADCAST_BYTES = 32 << 20


def nearest(vectors: DataFrame, questions: DataFrame, k: int, tie: str = "id") -> DataFrame:
    """(question_id, id, score, rank): the k vectors of the question's scope with the highest cosine.

    vectors: scope, id, vector, and `tie` (an insertion number, say) if it isn't id; questions: question_id, scope, vector.
    Invalid vectors take no part. Scores are rounded to 6 places before they are ranked.
    """
    dims, n = questions.agg(F.max(F.size("vector")), F.count("*")).first()
    if not n or not dims:
        return top(questions.select("question_id", F.lit(None).alias("id"), F.lit(0.0).alias("score")).limit(0), k)
    q = questions.where(vector_is_valid(F.col("vector"), dims)).select("question_id", "scope", "vector")
    v = vectors.where(vector_is_valid(F.col("vector"), dims)).select("scope", "id", F.col(tie).alias("tie"), "vector")
    if n * dims * 8 > BROADCAST_BYTES:
        pairs = q.withColumnRenamed("vector", "qv").join(v, "scope")
        scored = pairs.select("question_id", "id", "tie", F.round(cosine(F.col("qv"), F.col("vector")), 6).alias("score"))
    else:
        scored = _partial(v, q, k)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "tie"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "id", "score", "rank")


def _partial(v: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """Every batch's k best per question, by matrix products against the broadcast questions."""
    asked = q.toPandas()
    held = v.sparkSession.sparkContext.broadcast(
        {s: (g["question_id"].tolist(), _unit(g["vector"])) for s, g in asked.groupby("scope")}
    )
    ids, tie, qid = (x.simpleString() for x in (v.schema["id"].dataType, v.schema["tie"].dataType, q.schema["question_id"].dataType))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for scope, rows in b.groupby("scope"):
                if scope in held.value:
                    names, m = held.value[scope]
                    scores = np.round(_unit(rows["vector"]) @ m.T, 6)
                    for j, name in enumerate(names):
                        f = pd.DataFrame({"question_id": name, "id": rows["id"].to_numpy(), "tie": rows["tie"].to_numpy(), "score": scores[:, j]})
                        yield f.sort_values(["score", "tie"], ascending=[False, True]).head(k)

    return v.mapInPandas(work, f"question_id {qid}, id {ids}, tie {tie}, score double")


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centroids(vectors: DataFrame) -> DataFrame:
    """(scope, vector): the mean of each scope's vectors, by place."""
    each = vectors.select("scope", F.posexplode("vector").alias("at", "x"))
    mean = each.groupBy("scope", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias("vector"))
