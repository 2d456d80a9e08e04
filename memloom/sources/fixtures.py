"""The fixture tables seen as this library's tables; the catalogue's SQL uses the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.scalars import is_noise, label

START = "TIMESTAMP '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, their wall-clock times taken as UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def said_at(conv: Column, turn: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(F.expr(START)) + conv * 3_600_000_000 + turn * 60_000_000)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: ten users, a session a conversation, a third of the times given. seq only orders, so it needs no global count."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    return c.select(
        F.concat_ws(":", conv, turn).alias("record_id"), (conv % 10).cast("string").alias("user_id"), conv.cast("string").alias("session_id"), conv.cast("string").alias("request_id"),
        turn.cast("int").alias("idx"), "role", F.col("text").alias("content"), said_at(conv, turn).alias("occurred_at"), F.sha2("text", 256).alias("fingerprint"),
        (conv * 4096 + turn).alias("seq"), (turn % 3 == 0).alias("time_given"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window a user, over the first half of the conversations; those of users 3 and 7 aren't applied yet."""
    m = messages(spark, sf_dir).groupBy("user_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last"))
    status = F.when(F.col("user_id").isin("3", "7"), "compiled").otherwise("done")
    return m.select(F.concat("user_id", F.lit(":w"), "first_seq").alias("window_id"), "user_id", "first_seq", F.floor((F.col("first_seq") + F.col("last")) / 2).alias("last_seq"), F.lit(None).cast("string").alias("compiled"), status.alias("status"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, id, text): messages as searchable units, by user."""
    m = messages(spark, sf_dir)
    return m.select(F.col("user_id").alias("scope"), F.col("record_id").alias("id"), F.concat(label(F.col("role")), "content").alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, scope, text): the first eight words of each benchmark item, asked for one of ten users."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("question_id"), (F.col("item_id") % 10).cast("string").alias("scope"), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0)), 1, 8), " ").alias("text"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, parent, child, kind): in a conversation, turn t > 0 hangs under turn (t - 1) div 2."""
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    return c.select(F.col("conv_id").cast("string").alias("line_id"), F.concat_ws(":", "conv_id", F.expr("(turn - 1) div 2")).alias("parent"), F.concat_ws(":", "conv_id", "turn").alias("child"), F.when(F.col("turn") % 4 == 3, "part").otherwise("after").alias("kind"))


def edge_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known when the child was said; those of turn % 5 = 4 are retired five hours later."""
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    known = said_at(F.col("conv_id"), F.col("turn"))
    ended = F.when(F.col("turn") % 5 == 4, F.timestamp_micros(F.unix_micros(known) + 5 * 3_600_000_000))
    return c.select(F.col("conv_id").cast("string").alias("line_id"), F.concat_ws(":", "conv_id", F.expr("(turn - 1) div 2")).alias("parent"), F.concat_ws(":", "conv_id", "turn").alias("child"), known.alias("known_at"), ended.alias("retired_at"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("line_id"), F.concat_ws(":", "conv_id", "turn").alias("node_id"))


def node_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states a node: as said, and corrected an hour later for even turns; system messages have no readable state."""
    m = table(spark, sf_dir, "conversations")
    node, at = F.concat_ws(":", "conv_id", "turn"), said_at(F.col("conv_id"), F.col("turn"))
    base = m.select(node.alias("node_id"), at.alias("knowledge_at"), "role", "turn", F.array(node).alias("source_keys"))
    later = base.where("turn % 2 = 0").withColumn("knowledge_at", F.timestamp_micros(F.unix_micros("knowledge_at") + 3_600_000_000))
    both = base.withColumn("v", F.lit(1)).unionByName(later.withColumn("v", F.lit(2)))
    return both.select("node_id", F.concat_ws("#", "node_id", "v").alias("state_id"), "knowledge_at", F.col("knowledge_at").alias("created_at"), (F.col("role") != "system").alias("readable"), "source_keys", (F.col("turn") % 7 != 6).alias("evidence_complete"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("node_id"), said_at(F.col("conv_id"), F.col("turn")).alias("known_at"), F.lit(None).cast("timestamp").alias("retired_at"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in compiler's blocks: one for each message that isn't noise."""
    m = messages(spark, sf_dir).where(~is_noise(F.col("role"), F.col("content")))
    return m.select("user_id", F.concat(F.lit("sb:"), "record_id").alias("block_id"), "record_id", F.col("content").alias("text"), "occurred_at", "seq", "session_id", "time_given")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, id, content, lifecycle): documents as memories, their language as scope; toxic ones are not active."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("bad")).distinct()
    return d.join(bad, "doc_id", "left").select(F.col("lang").alias("scope"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("bad"), "invalidated").otherwise("active").alias("lifecycle"))


def label_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, scope, vector): each label's first vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("string").alias("question_id"), F.col("label").alias("scope"), "vector")
