"""Which side of the terminator a block is on: happened, or in progress.

said: memory_id, happened, known_at; settled: memory_id, settled_at, by_memory_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.scalars import stated_end

PAST, OPEN = "happened", "in progress"


def first_said(said: DataFrame) -> DataFrame:
    """How a block was said first; it doesn't change later."""
    return said.groupBy("memory_id").agg(F.min_by("happened", F.struct("known_at", F.col("happened"))).alias("happened"))


def settled_by(settled: DataFrame, now: Column) -> DataFrame:
    """memory_id, by: the blocks that settled each one by `now`, in order."""
    own = F.array_sort(F.collect_set(F.struct("settled_at", "by_memory_id")))
    return settled.where(F.col("settled_at") <= now).groupBy("memory_id").agg(own.alias("s")).select("memory_id", F.transform("s", lambda x: x.by_memory_id).alias("by"))


def sides(blocks: DataFrame, said: DataFrame, settled: DataFrame, now: Column) -> DataFrame:
    """blocks (memory_id, content) with `side` at `now` and `confirmed`; both null for blocks on no line.

    A block is past if it was said so, if its stated time has passed, or if a block settled it. A stated time alone confirms nothing.
    """
    by = settled_by(settled, now)
    own = blocks.join(first_said(said), "memory_id", "left").join(by, "memory_id", "left")
    over = F.coalesce(stated_end(F.col("content")) <= now, F.lit(False))
    confirmed = F.col("happened") | F.col("by").isNotNull()
    side = F.when(confirmed | over, PAST).otherwise(OPEN)
    on_line = F.col("happened").isNotNull()
    return own.withColumn("side", F.when(on_line, side)).withColumn("confirmed", F.when(on_line, confirmed))


def settle_references(signals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(memory_id, settled_at, by_memory_id, ok): what blocks say they settle.

    signals: batch_id, ord, memory_id, at, ref (`b<k>`: an earlier block of the batch, by number from 1; else a node's id);
    nodes: node_id, block_id. A reference to nothing earlier settles nothing and is returned with ok false.
    """
    number = F.when(F.col("ref").rlike("^b[0-9]+$"), F.substr("ref", F.lit(2)).cast("long"))
    own = signals.select("batch_id", F.col("ord").alias("k"), F.col("memory_id").alias("target")).distinct()
    s = signals.withColumn("k", number).join(own, ["batch_id", "k"], "left").join(nodes.select(F.col("node_id").alias("ref"), F.col("block_id").alias("known")), "ref", "left")
    target = F.when(F.col("k").isNotNull(), F.when(F.col("k") < F.col("ord"), F.col("target"))).otherwise(F.col("known"))
    return s.select(target.alias("memory_id"), F.col("at").alias("settled_at"), F.col("memory_id").alias("by_memory_id"), target.isNotNull().alias("ok"))
