"""Accepted understandings as append-only revisions, signal routing, placements on lines, and what a reader shows of them.

lineage: region, revision, baseline_id, content, support (array), origin (commit, revision, thread), created_at.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.scalars import minute_stamp
from memloom.stage import materialize

#: Supports that a revision keeps.
KEEP = 100
LINEAGE = "region string, revision int, baseline_id string, content string, support array<string>, origin string, created_at timestamp"


def heads(lineage: DataFrame) -> DataFrame:
    """Each region's newest revision."""
    w = Window.partitionBy("region").orderBy(F.desc("revision"))
    return lineage.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _baseline(region: str, base: str | None, content: str, support: list[str]) -> str:
    body = json.dumps([region, base, content, support], ensure_ascii=False)
    return "base_" + hashlib.sha256(body.encode()).hexdigest()[:24]


def promote(lineage: DataFrame, signals: DataFrame) -> DataFrame:
    """lineage after signals (region, ord, content, support, at), in order.

    The first one of a region is a commit, each later one a revision that keeps the support it continues from, the last KEEP. A signal
    that says what the head says, on support that it has, adds nothing, so a replay changes nothing.
    """
    log = signals.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("ord", "content", "support", "at"))).alias("log"))
    both = log.join(heads(lineage).select("region", F.struct("revision", "baseline_id", "content", "support").alias("head")), "region", "left")

    def work(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                head = None if r.head is None else dict(r.head)
                for s in r.log:
                    new = list(dict.fromkeys(s["support"]))
                    if head is not None and head["content"] == s["content"] and set(new) <= set(head["support"]):
                        continue
                    merged = list(dict.fromkeys([*([] if head is None else head["support"]), *new]))[-KEEP:]
                    head = {"revision": 1 if head is None else head["revision"] + 1, "baseline_id": _baseline(r.region, head and head["baseline_id"], s["content"], merged), "content": s["content"], "support": merged}
                    out.append({"region": r.region, **head, "origin": "commit" if head["revision"] == 1 else "revision", "created_at": s["at"]})
            yield pd.DataFrame(out, columns=["region", "revision", "baseline_id", "content", "support", "origin", "created_at"])

    return lineage.unionByName(both.mapInPandas(work, LINEAGE))


def accepted(lineage: DataFrame, memories: DataFrame) -> DataFrame:
    """Heads with evidence_complete: every support is an active memory; and newest, the latest time of their support."""
    h = heads(lineage)
    live = memories.where("lifecycle = 'active'").select("memory_id", "occurred_at", F.lit(True).alias("live"))
    support = h.select("region", F.explode_outer("support").alias("memory_id")).join(live, "memory_id", "left")
    whole = support.groupBy("region").agg(F.bool_and(F.coalesce("live", F.lit(False))).alias("evidence_complete"), F.max("occurred_at").alias("newest"))
    return h.join(whole, "region")


def route_signals(signals: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promotions, thread_events) of block signals (region, ord, action, content, support, settles, commit, at).

    A commit, or a settling signal on a region with a head, goes to the lineage; all others are thread events.
    """
    known = heads(lineage).select("region", F.lit(True).alias("known"))
    s = signals.join(known, "region", "left")
    up = F.coalesce(F.col("commit"), F.lit(False)) | (F.coalesce(F.col("settles"), F.lit(False)) & F.col("known").isNotNull())
    return s.where(up).drop("known"), s.where(~up).drop("known")


def superseded_threads(threads: DataFrame, understood: DataFrame, memories: DataFrame) -> DataFrame:
    """Open threads (thread_id, region, support) that no accepted head (region, newest) has caught up with."""
    times = threads.select("thread_id", F.explode_outer("support").alias("memory_id")).join(memories.select("memory_id", "occurred_at"), "memory_id", "left")
    mine = times.groupBy("thread_id").agg(F.max("occurred_at").alias("mine"))
    both = threads.join(mine, "thread_id").join(understood.select("region", "newest"), "region", "left")
    return both.where(~F.coalesce(F.col("newest") >= F.col("mine"), F.lit(False))).drop("newest", "mine")


def matter_text(head: Column, latest: Column, question: Column, steps: Column, state: Column) -> Column:
    """One matter as one text: its head, its steps in order, its state. steps: an array of texts, in order."""
    rows = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    top = F.concat(F.lit("["), head, F.coalesce(F.concat(F.lit(" | last update "), minute_stamp(latest)), F.lit("")), F.lit("] "), question)
    tail = F.when(state != "", F.array(F.concat(F.lit("Current state: "), state))).otherwise(F.expr("CAST(array() AS array<string>)"))
    return F.array_join(F.concat(F.array(top, F.lit("Steps in order:")), rows, tail), "\n")


def source_items(refs: DataFrame, limit: int) -> DataFrame:
    """Each parent's first `limit` sources (question_id, parent_rank, parent, source_key, occurred_at) by time, then key; a source shows under its first parent only."""
    first = Window.partitionBy("question_id", "source_key").orderBy("parent_rank", "occurred_at")
    once = refs.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    place = F.row_number().over(Window.partitionBy("question_id", "parent").orderBy("occurred_at", "source_key"))
    return once.withColumn("place", place).where(F.col("place") <= limit)


def earlier_stretches(stretches: DataFrame, recent: int = 3, most: int = 8) -> DataFrame:
    """Closed stretches a window is compared with: the `recent` latest, then the nearest by cosine, `most` in all.

    stretches: window_id, stretch_id, last_seq, cosine (null without vectors: the latest fill the rest).
    """
    w = Window.partitionBy("window_id")
    s = stretches.withColumn("late", F.row_number().over(w.orderBy(F.desc("last_seq"), "stretch_id"))).withColumn("near", F.row_number().over(w.orderBy(F.desc_nulls_last("cosine"), F.desc("last_seq"), "stretch_id")))
    order = w.orderBy(F.when(F.col("late") <= recent, 0).otherwise(1), F.when(F.col("late") <= recent, F.col("late")).otherwise(F.col("near")))
    return s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("late", "near")


def block_view(memories: DataFrame, meta: DataFrame, relations: DataFrame) -> DataFrame:
    """memories with their metadata (memory_id, members, context) and their relations from both ends, both empty where there are none."""
    ends = relations.select(F.explode(F.array(F.struct(F.col("from_memory_id").alias("memory_id"), F.lit("out").alias("way"), F.col("to_memory_id").alias("other")), F.struct(F.col("to_memory_id").alias("memory_id"), F.lit("in").alias("way"), F.col("from_memory_id").alias("other")))).alias("e"), "relation")
    own = ends.groupBy("e.memory_id").agg(F.array_sort(F.collect_set(F.struct(F.col("e.way").alias("way"), "relation", F.col("e.other").alias("other")))).alias("relations"))
    out = memories.join(meta, "memory_id", "left").join(own, "memory_id", "left")
    return out.withColumn("relations", F.coalesce("relations", F.expr("CAST(array() AS array<struct<way:string,relation:string,other:string>>)")))


# ---------------------------------------------------------------- placements

PLACED = "user_id string, memory_id string, ord long, line_id string, node_id string, parent string, kind string, happened boolean, failure string"


def apply_placements(placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """(PLACED) for placements (user_id, batch, ord, memory_id, after, part, happened), each block put where it goes on from.

    `after` is `b<k>`, the block of that number in the same batch, or a known node's id (nodes: node_id, line_id); one that isn't
    earlier is dropped and named in `failure`, and the block then starts a line of its own. A user's blocks are placed in order, in one
    group of narrow rows.
    """
    known = nodes.select(F.col("node_id").alias("after"), F.col("line_id").alias("known_line"))
    rows = placements.join(known, "after", "left").select("user_id", "batch", "ord", "memory_id", "after", "part", "happened", "known_line")

    def digest(*parts: str) -> str:
        return hashlib.sha256("|".join(parts).encode()).hexdigest()[:32]

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, batch in f.sort_values(["batch", "ord"]).groupby("batch", sort=True):
            placed: list[tuple[str, str]] = []  # node and line, by number in the batch
            for r in batch.itertuples(index=False):
                parent = line = failure = None
                if isinstance(r.after, str):
                    number = int(r.after[1:]) if r.after[:1] == "b" and r.after[1:].isdigit() else 0
                    if 0 < number <= len(placed):
                        parent, line = placed[number - 1]
                    elif isinstance(r.known_line, str):
                        parent, line = r.after, r.known_line
                    else:
                        failure = f"dropped ref {r.after}"
                line = line or "line_" + digest("line", r.user_id, r.memory_id)
                node = "node_" + digest("node", line, r.memory_id)
                placed.append((node, line))
                out.append({"user_id": r.user_id, "memory_id": r.memory_id, "ord": r.ord, "line_id": line, "node_id": node, "parent": parent, "kind": None if parent is None else "part" if r.part else "after", "happened": bool(r.happened), "failure": failure})
        return pd.DataFrame(out, columns=["user_id", "memory_id", "ord", "line_id", "node_id", "parent", "kind", "happened", "failure"])

    return rows.groupBy("user_id").applyInPandas(fold, PLACED)


def placed_tables(placed: DataFrame, at: Column) -> dict[str, DataFrame]:
    """nodes, edges, edge_revisions, node_memberships and said rows of what was placed; ids are deterministic, so appending them again adds no new key."""
    placed = materialize(placed, "placed")
    linked = placed.where("parent IS NOT NULL").select("line_id", "parent", F.col("node_id").alias("child"), "kind")
    return {
        "nodes": placed.select("node_id", "line_id", F.col("memory_id").alias("block_id"), at.alias("created_at")),
        "edges": linked,
        "edge_revisions": linked.select("line_id", "parent", "child", at.alias("known_at"), F.lit(None).cast("timestamp").alias("retired_at")),
        "node_memberships": placed.select("node_id", at.alias("known_at"), F.lit(None).cast("timestamp").alias("retired_at")),
        "said": placed.select("memory_id", "happened", at.alias("known_at")),
    }
