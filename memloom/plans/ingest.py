"""The write path as a batch: requests, raw store, windows, blocks, memories, lines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.scalars import is_noise
from memloom.operators.history import WindowPolicy, cut_windows, pending
from memloom.operators.memory import admit
from memloom.sources.requests import append_requests, check_requests
from memloom.sources.store import Store
from memloom.streaming.windows import first_of

#: A compiler: messages of one window (dicts, in order) -> blocks (dicts with text, sources, happened, under).
Compiler = Callable[[list[dict]], list[dict]]
BLOCKS = "user_id string, window_id string, ord int, text string, sources array<string>, happened boolean, under int"


def one_block_a_message(window: list[dict]) -> list[dict]:
    """The stand-in compiler: every message is a block that goes on from the one before."""
    return [{"text": m["content"], "sources": [m["record_id"]], "happened": True, "under": i - 1 if i else None} for i, m in enumerate(window)]


def compile_windows(messages: DataFrame, windows: DataFrame, compiler: Compiler = one_block_a_message) -> DataFrame:
    """(BLOCKS): each window's messages, noise left out, given to the compiler; a window is bounded by its policy."""
    w = windows.where("NOT raw_only").select("window_id", F.col("user_id").alias("w_user"), "first_seq", "last_seq")
    own = messages.where(~is_noise(F.col("role"), F.col("content")))
    inside = own.join(w, (own["user_id"] == w["w_user"]) & F.col("seq").between(F.col("first_seq"), F.col("last_seq")))
    rows = inside.select("user_id", "window_id", "seq", "record_id", "role", "content")

    def work(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        made = compiler(f.to_dict("records"))
        out = [{"user_id": f["user_id"].iloc[0], "window_id": f["window_id"].iloc[0], "ord": i, "text": b["text"], "sources": b["sources"], "happened": b["happened"], "under": b.get("under")} for i, b in enumerate(made)]
        return pd.DataFrame(out, columns=["user_id", "window_id", "ord", "text", "sources", "happened", "under"]).astype({"under": "Int32"})

    return rows.groupBy("user_id", "window_id").applyInPandas(work, BLOCKS)


def journal(windows: DataFrame, compiled: DataFrame) -> DataFrame:
    """windows and the newly compiled ones; what a window has stays, and of several new entries the smallest."""
    return windows.unionByName(first_of(compiled, "window_id").join(windows.select("window_id"), "window_id", "left_anti"))


def drop_unfinished(store: Store) -> None:
    """Messages are written before their requests, so messages without one are what a crash left, and a replay brings them again."""
    messages, done = store.read("messages"), store.read("requests").select("request_id")
    if messages.join(done, "request_id", "left_anti").limit(1).count():
        store.write("messages", messages.join(done, "request_id", "left_semi"))


def add(store: Store, requests: DataFrame, received_at: Column, policy: WindowPolicy, compiler: Compiler = one_block_a_message, final: bool = False) -> DataFrame:
    """Take requests (body) into the store: raw rows first, then the windows that close, their blocks as memories. Returns refused bodies and conflicts."""
    valid, rejected = check_requests(requests)
    drop_unfinished(store)
    new_requests, new_messages, conflicts = append_requests(valid, store.read("requests"), store.read("messages"), received_at)
    store.append("messages", new_messages)
    store.append("requests", new_requests)
    messages, windows = store.read("messages"), store.read("windows")
    cut = cut_windows(pending(messages, windows), policy, final)
    blocks = compile_windows(messages, cut, compiler)
    done = cut.select("window_id", "user_id", "first_seq", "last_seq", F.lit(None).cast("string").alias("compiled"), F.lit("done").alias("status"))
    scope = F.to_json(F.struct(F.lit("user").alias("domain"), "user_id"))
    candidates = blocks.select(scope.alias("scope_key"), F.col("text").alias("content"), F.col("sources").alias("source_keys"), F.col("window_id").alias("observation_id"), F.col("sources").alias("evidence_refs"))
    sources = messages.select(scope.alias("scope_key"), F.col("record_id").alias("source_key"), "occurred_at")
    memories, refused = admit(candidates, sources, store.read("memories"), received_at)
    store.write("memories", memories)
    store.write("windows", journal(windows, done))
    return rejected.select(F.col("body").alias("what"), "error").unionByName(conflicts.select(F.col("request_id").alias("what"), F.lit("replayed with other content").alias("error"))).unionByName(refused.select(F.col("content").alias("what"), F.lit("a source is not current").alias("error")))
