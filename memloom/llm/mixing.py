"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

The rows of a source are numbered and cut into blocks. With u a source's share of the
weights, its block k (from 0) is released at slot floor(k/u) and due by slot
ceil((k+1)/u); each slot goes to the released block with the earliest deadline, ties to
the smaller source. On one queue with shares that add up to 1 this never misses a
deadline, so after t slots a source is less than one block off u*t. When a source ends,
the others go on by their weights from the next slot, so every row has a place.

The schedule has at most BLOCKS blocks plus one a source: blocks grow with the table,
the schedule doesn't.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 2048
#: Rows of a source that are numbered in one task, about.
BUCKET_ROWS = 2000
#: Sources up to which the schedule is broadcast; beyond, Spark joins it as it likes.
BROADCAST_SOURCES = 10_000
SMOOTHING = 0.5
#: Weights are whole numbers of this part of the largest one.
WEIGHT_UNITS = 1_000_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def integer_weights(counts: DataFrame, weights: Mapping[str | None, float] | None, total: int) -> DataFrame:
    """counts (src, n) with a positive integer weight `a`.

    weights: by source, of any scale, rounded to 1/WEIGHT_UNITS of the largest; one that would round to nothing is
    refused. A source that they lack gets the smallest of them. None: the row counts to the power SMOOTHING, in
    thousandths, which lifts small sources.
    """
    if weights is None:
        a = F.pow(F.col("n") / F.lit(float(max(total, 1))), F.lit(SMOOTHING))
        scale = 1000.0
    else:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must be positive")
        if min(weights.values()) * WEIGHT_UNITS < max(weights.values()):
            raise ValueError(f"a weight is under 1/{WEIGHT_UNITS} of the largest")
        items = [x for k, w in weights.items() for x in (F.lit(_encode(k)), F.lit(float(w)))]
        a = F.coalesce(F.element_at(F.create_map(*items), F.col("src")), F.lit(float(min(weights.values()))))
        scale = float(WEIGHT_UNITS) / max(weights.values())
    return counts.withColumn("a", F.greatest(F.round(a * scale).cast("long"), F.lit(1).cast("long")))


def _encode(source: str | None) -> str:
    return "null" if source is None else f"={source}"


def schedule(counts: DataFrame, block_rows: int) -> DataFrame:
    """(src, block, slot) from (src, n, a): one fold over the slots, its state one entry a source."""
    blocks = F.expr(f"CAST(ceil(n / {block_rows}) AS long)")
    zero = F.lit(0).cast("long")
    one = counts.select(F.struct("src", F.col("a"), blocks.alias("left"), zero.alias("k"), zero.alias("done")).alias("s")).groupBy().agg(F.array_sort(F.collect_list("s")).alias("s"))
    total = F.aggregate("s", zero, lambda acc, x: acc + x["left"])
    weight = F.aggregate("s", zero, lambda acc, x: acc + x["a"])
    sources = F.transform("s", lambda x, i: F.struct(i.alias("i"), x["a"].alias("a"), x["left"].alias("left"), x["k"].alias("k"), x["done"].alias("done")))
    start = F.struct(sources.alias("s"), zero.alias("t"), weight.alias("w"), F.expr("CAST(array() AS array<struct<i:int,block:bigint>>)").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        w, t = acc["w"], acc["t"]
        ready = F.filter(acc["s"], lambda x: (x["left"] > 0) & (F.floor(x["k"] * w / x["a"]) <= t))
        due = F.array_min(F.transform(ready, lambda x: F.struct(F.ceil((x["k"] + 1) * w / x["a"]).alias("due"), x["i"].alias("i"))))

        def take(i: Column) -> Column:
            def place(c: Column) -> Column:
                ends = c["left"] == 1
                rest = F.transform(
                    acc["s"],
                    lambda x: F.struct(
                        x["i"].alias("i"), x["a"].alias("a"),
                        F.when(x["i"] == i, x["left"] - 1).otherwise(x["left"]).alias("left"),
                        F.when(ends, zero).when(x["i"] == i, x["k"] + 1).otherwise(x["k"]).alias("k"),
                        F.when(x["i"] == i, x["done"] + 1).otherwise(x["done"]).alias("done"),
                    ),
                )
                return F.struct(
                    rest.alias("s"), F.when(ends, zero).otherwise(t + 1).alias("t"), F.when(ends, w - c["a"]).otherwise(w).alias("w"),
                    F.concat(acc["out"], F.array(F.struct(i.alias("i"), c["done"].alias("block")))).alias("out"),
                )

            return _let(F.element_at(acc["s"], i + 1), place)

        return _let(due["i"], take)

    slots = F.when(total > 0, F.sequence(F.lit(1).cast("long"), total)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    out = F.aggregate(slots, start, step, lambda acc: acc["out"])
    return one.select("s", F.posexplode(out).alias("slot", "o")).select(F.element_at("s", F.col("o.i") + 1)["src"].alias("src"), F.col("o.block").alias("block"), F.col("slot").cast("long").alias("slot"))


def assign(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int | None = None, keep: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, source, block, slot, position (dense order of the mix, by slot, then within the block).

    docs needs doc_id and source. A null source is a source of its own; null ids and repeated rows
    are numbered like others; an empty table gives no rows. keep: all other columns of docs stay, in a
    struct `row`. Rows of a source come by the MD5 of doc_id, so a block is a fair sample of its source. With keep, rows of
    one doc_id come by a hash of all their columns, and rows without one are dealt to buckets by it; rows that are
    alike in every column are alike in any order.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    row = F.xxhash64(*(q for q, f in zip(quoted, docs.schema) if "map<" not in f.dataType.simpleString())) if keep else F.lit(0).cast("long")
    own_id = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), row.cast("string")) if keep else F.lit(""))
    own = docs.select(
        F.col("doc_id"), F.col("source"), row.alias("alike"),
        F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("src"),
        F.md5(own_id).alias("h"), *([F.struct(*quoted).alias("row")] if keep else []),
    )
    counts = own.groupBy("src").agg(F.count("*").alias("n"))
    total, n_sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    block_rows = block_rows or max(1, -(-total // BLOCKS))
    # a source has as many buckets as it needs, so a hot one is numbered in many tasks
    buckets = counts.select("src", F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("buckets"))
    own = own.join(F.broadcast(buckets) if n_sources <= BROADCAST_SOURCES else buckets, "src").withColumn("bucket", F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("long") % F.col("buckets")).drop("buckets")
    sizes = own.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("src", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "alike"))
    ranked = own.withColumn("rn", within).join(offsets, ["src", "bucket"]).withColumn("rank", F.col("before") + F.col("rn") - 1)
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long"))
    slots = schedule(integer_weights(counts, weights, total), block_rows)
    # where a slot starts: the rows of all slots before it
    size = F.least(F.lit(block_rows).cast("long"), F.col("n") - F.col("block") * block_rows)
    slots = slots.join(counts, "src").withColumn("at", F.coalesce(F.sum(size).over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    if n_sources <= BROADCAST_SOURCES:
        slots = F.broadcast(slots)
    out = ranked.join(slots, ["src", "block"]).withColumn("position", F.col("at") + F.col("rank") - F.col("block") * block_rows)
    return out.select("doc_id", "source", "block", "slot", "position", *(["row"] if keep else []))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, rows_per_file: int = 50_000) -> DataFrame:
    """docs in the order of the mix: the same rows and columns, dealt to partitions by position and sorted there.

    docs needs doc_id and source; null sources are a source of their own, null ids and repeated rows stay as
    they are; an empty table stays empty. Columns may have any names.
    """
    placed = assign(docs, weights, keep=True)
    total = docs.count()
    parts = max(1, -(-total // rows_per_file), min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // 1000)))
    dealt = placed.repartitionById(parts, F.floor(F.col("position") * parts / max(total, 1)).cast("int"))
    return dealt.sortWithinPartitions("position").select("row.*")
