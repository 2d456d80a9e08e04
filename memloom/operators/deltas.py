"""Semantic deltas as a batch: check, close, and turn into memories, relations, supersessions and receipts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.memory import Conflict, memory_identity, set_lifecycle
from memloom.operators.parsers import DeltaError, close_delta
from memloom.stage import materialize

BLOCKS = "source_key string, scope_key string, ord int, members array<string>, content string, context array<string>, dependencies array<struct<from_point_id:string,target_kind:string,target_id:string,relation:string,boundary_policy:string,lifecycle_effect:string>>, error_code string, error string"


def close_deltas(deltas: DataFrame) -> DataFrame:
    """(BLOCKS) of deltas (source_key, scope_key, payload, activated): a row a block, or one row with the error that refuses all of a delta."""

    names = ["source_key", "scope_key", "ord", "members", "content", "context", "dependencies", "error_code", "error"]

    def work(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                base = dict.fromkeys(names) | {"source_key": r.source_key, "scope_key": r.scope_key}
                try:
                    blocks = close_delta(r.payload, tuple(r.activated if r.activated is not None else ()))
                except DeltaError as e:
                    out.append({**base, "error_code": e.code, "error": str(e)})
                    continue
                out += [{**base, "ord": i, "members": x["member_point_ids"], "content": x["analysis_text"], "context": x["context_memory_ids"], "dependencies": x["dependencies"]} for i, x in enumerate(blocks)]
            yield pd.DataFrame(out, columns=names).astype({"ord": "Int32"})

    return deltas.select("source_key", "scope_key", "payload", "activated").mapInPandas(work, BLOCKS)


def admit_deltas(deltas: DataFrame, memories: DataFrame, relations: DataFrame, transitions: DataFrame, at: Column) -> dict[str, DataFrame]:
    """memories, relations, transitions after the deltas, and a receipt per delta (source_key, status, memory_ids, error).

    A delta whose activated memories aren't active in its scope is refused like an invalid one. Ids are deterministic, so a replay
    adds nothing. A memory that a dependency supersedes takes that state.
    """
    blocks = materialize(close_deltas(deltas), "blocks")
    need = deltas.select("source_key", "scope_key", F.explode(F.array_distinct("activated")).alias("memory_id"))
    live = memories.where("lifecycle = 'active'").select("memory_id", "scope_key")
    done = blocks.where("content IS NOT NULL").withColumn("memory_id", memory_identity(F.col("scope_key"), F.concat(F.array("source_key"), F.col("members")), F.col("content")))
    replayed = done.join(memories.select("memory_id"), "memory_id", "left_semi").select("source_key").distinct()
    lost = need.join(live, ["memory_id", "scope_key"], "left_anti").select("source_key").distinct().join(replayed, "source_key", "left_anti")
    ok = materialize(done.join(lost, "source_key", "left_anti"), "admitted")
    new = ok.join(memories.select("memory_id"), "memory_id", "left_anti")
    rows = new.select(
        "memory_id", "scope_key", "content", F.array("source_key").alias("source_keys"), F.col("source_key").alias("observation_id"), F.col("members").alias("evidence_refs"),
        at.alias("occurred_at"), at.alias("committed_at"), F.lit("active").alias("lifecycle"),
    )
    by_point = ok.select("source_key", F.explode("members").alias("point"), F.col("memory_id").alias("to_block"))
    each = ok.select("source_key", "memory_id", F.explode("dependencies").alias("d"))
    targets = each.join(by_point, (by_point["source_key"] == each["source_key"]) & (F.col("d.target_kind") == "point") & (F.col("d.target_id") == by_point["point"]), "left").select(each["source_key"], "memory_id", "d", "to_block")
    to = F.when(F.col("d.target_kind") == "memory", F.col("d.target_id")).otherwise(F.col("to_block"))
    linked = targets.select(F.col("memory_id").alias("from_memory_id"), to.alias("to_memory_id"), F.col("d.relation").alias("relation"), F.col("d.boundary_policy").alias("boundary_policy"), F.col("d.lifecycle_effect").alias("lifecycle_effect"), F.col("source_key").alias("interaction_id"))
    linked = linked.where("to_memory_id IS NOT NULL AND from_memory_id <> to_memory_id").distinct()
    fresh = materialize(linked.join(relations, relations.columns, "left_anti"), "relations")
    gone = fresh.where("lifecycle_effect = 'supersede'").select(F.col("to_memory_id").alias("memory_id"), F.lit("superseded").alias("lifecycle"), at.alias("at")).distinct()
    after, moved = set_lifecycle(memories.unionByName(rows.select(*memories.columns)), transitions, gone)
    receipts = (
        deltas.select("source_key").distinct()
        .join(ok.groupBy("source_key").agg(F.array_sort(F.collect_set("memory_id")).alias("memory_ids")), "source_key", "left")
        .join(blocks.where("error IS NOT NULL").select("source_key", "error"), "source_key", "left")
        .join(lost.withColumn("lost", F.lit("an activated memory is not active in the scope")), "source_key", "left")
    )
    error = F.coalesce("error", "lost")
    receipts = receipts.select("source_key", F.when(error.isNotNull(), "refused").otherwise("complete").alias("status"), "memory_ids", error.alias("error"))
    return {"memories": after, "relations": relations.unionByName(fresh.select(*relations.columns)), "transitions": moved, "receipts": receipts}


def compatible_replay(frozen: str, again: str) -> None:
    """Raises if a frozen compilation comes again with other content."""
    if json.loads(frozen) != json.loads(again):
        raise Conflict("conflicting accepted compilation")
