"""Canonical memories: admission, first-wins inserts, lifecycle, source invalidation, the change queue.

Tables are immutable snapshots: an operation takes snapshots and returns the next ones.
memories: memory_id, scope_key, content, ..., lifecycle; memory_sources: scope_key, source_key, version_key, memory_id;
projection_queue: intent_id, memory_id, target, operation, status, attempts, provider_ref, last_error, generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.stage import materialize

ACTIVE, SUPERSEDED, INVALIDATED = "active", "superseded", "invalidated"


class Conflict(ValueError):
    """An identity came again with other content, or an authority is exceeded."""


def memory_identity(scope_key: Column, source_keys: Column, content: Column) -> Column:
    """A memory's id: from its scope, its sources in order of their keys, and its words."""
    return F.concat(F.lit("mem_"), F.substr(F.sha2(F.to_json(F.struct(scope_key.alias("scope"), F.array_sort(F.array_distinct(source_keys)).alias("sources"), content.alias("content"))), 256), F.lit(1), F.lit(32)))


def insert(stored: DataFrame, new: DataFrame, key: str = "memory_id") -> DataFrame:
    """stored and the new rows under new keys. The same row again is nothing new; another row under a known key raises."""
    cols = stored.columns
    fingerprint = F.xxhash64(*[F.to_json(F.struct(*cols))])
    coming = new.select(*cols).withColumn("__f", fingerprint)
    known = stored.select(key, fingerprint.alias("__g"))
    clash = coming.join(known, key).where("__f <> __g").select(key).union(coming.groupBy(key).agg(F.count_distinct("__f").alias("n")).where("n > 1").select(key))
    if clash.limit(1).count():
        raise Conflict(f"{key} came again with another value")
    return stored.unionByName(coming.dropDuplicates([key]).join(known, key, "left_anti").select(*cols))


def admit(candidates: DataFrame, sources: DataFrame, stored: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(memories, rejected): candidates (scope_key, content, source_keys, observation_id, evidence_refs) become memories.

    Every source must be current in sources (scope_key, source_key, occurred_at); else the candidate is rejected. The id is
    deterministic and the first commit's times stay, so a replay changes nothing. occurred_at is the least of the sources' times.
    """
    own = candidates.withColumn("memory_id", memory_identity(F.col("scope_key"), F.col("source_keys"), F.col("content"))).dropDuplicates(["memory_id"])
    need = own.select("memory_id", "scope_key", F.explode(F.array_distinct("source_keys")).alias("source_key"))
    have = need.join(sources.select("scope_key", "source_key", "occurred_at"), ["scope_key", "source_key"], "left").groupBy("memory_id").agg(F.min("occurred_at").alias("occurred_at"), F.bool_and(F.col("occurred_at").isNotNull()).alias("whole"))
    checked = own.join(have, "memory_id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    fresh = checked.where("whole").join(stored.select("memory_id"), "memory_id", "left_anti").withColumn("committed_at", at).withColumn("lifecycle", F.lit(ACTIVE))
    return stored.unionByName(fresh.select(*stored.columns)), checked.where("NOT whole").drop("whole", "occurred_at")


def set_lifecycle(memories: DataFrame, transitions: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, transitions) after changed (memory_id, lifecycle, at): an active memory takes the new lifecycle; its first transition's time stays."""
    one = changed.groupBy("memory_id").agg(F.min_by(F.struct("lifecycle", "at"), F.struct("at", "lifecycle")).alias("c"))
    active = memories.join(one, "memory_id", "left")
    out = active.withColumn("lifecycle", F.when((F.col("lifecycle") == ACTIVE) & F.col("c").isNotNull(), F.col("c.lifecycle")).otherwise(F.col("lifecycle"))).select(*memories.columns)
    moved = active.where((F.col("lifecycle") == ACTIVE) & F.col("c").isNotNull()).select("memory_id", F.col("c.lifecycle").alias("lifecycle"), F.col("c.at").alias("transitioned_at"))
    return out, transitions.unionByName(moved.join(transitions.select("memory_id"), "memory_id", "left_anti"))


def stale_memories(memories: DataFrame, memory_sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Active memories that rest on another version of a ref (scope_key, source_key, version_key, deleted, at), or on a deleted one: memory_id, lifecycle, at."""
    r = refs.select("scope_key", "source_key", F.col("version_key").alias("now_version"), "deleted", "at")
    stale = memory_sources.join(r, ["scope_key", "source_key"]).where(F.col("deleted") | (F.col("version_key") != F.col("now_version")))
    hit = memories.where(F.col("lifecycle") == ACTIVE).join(stale.groupBy("memory_id").agg(F.min("at").alias("at")), "memory_id")
    return hit.select("memory_id", F.lit(INVALIDATED).alias("lifecycle"), "at")


def superseded(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Changes (memory_id, lifecycle, at) for what new (memory_id, scope_key, supersedes, committed_at) replaces; a target of another scope raises."""
    named = new.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id"), F.col("scope_key").alias("by_scope"), F.col("committed_at").alias("at"))
    both = named.join(memories.select("memory_id", "scope_key"), "memory_id", "left")
    if both.where("scope_key IS NULL OR scope_key <> by_scope").limit(1).count():
        raise Conflict("a memory can supersede only one of its own scope")
    return both.select("memory_id", F.lit(SUPERSEDED).alias("lifecycle"), "at")


def supersede_chain(links: DataFrame) -> DataFrame:
    """(memory_id, head, steps): from each memory along links (memory_id, superseded_by) to the newest one, the farthest where they fork.

    Each round doubles the steps that are followed, to the end of the longest chain; a cycle has no newest memory and raises.
    """
    jump = materialize(links.select("memory_id", F.col("superseded_by").alias("to")).distinct(), "jump")
    most, reach = jump.count(), 1
    best = jump.groupBy("memory_id").agg(F.max(F.struct(F.lit(1).alias("steps"), F.col("to").alias("head"))).alias("far"))
    while jump.limit(1).count():
        if reach > most:
            raise Conflict("memories supersede each other in a cycle")
        beyond = best.select(F.col("memory_id").alias("to"), F.struct((F.col("far.steps") + reach).alias("steps"), F.col("far.head").alias("head")).alias("far"))
        best = materialize(best.unionByName(jump.join(beyond, "to").select("memory_id", "far")).groupBy("memory_id").agg(F.max("far").alias("far")), "best")
        jump = materialize(jump.join(jump.select(F.col("memory_id").alias("to"), F.col("to").alias("next")), "to").select("memory_id", F.col("next").alias("to")).distinct(), "jump")
        reach *= 2
    return best.select("memory_id", "far.head", "far.steps")


def missing_support(memories: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of named (memory_id, scope_key, support_id) whose support isn't a memory of the same scope."""
    have = memories.select(F.col("memory_id").alias("support_id"), "scope_key")
    return named.join(have, ["support_id", "scope_key"], "left_anti")


def relations_of(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations that touch an id (memory_id) at either end, each once per id: the OR join as two equi joins."""
    ends = [relations.withColumn("memory_id", F.col(c)) for c in ("from_memory_id", "to_memory_id")]
    return ends[0].union(ends[1]).join(ids.select("memory_id").distinct(), "memory_id").distinct()


# ---------------------------------------------------------------- jobs


def freeze_jobs(jobs: DataFrame, frozen: DataFrame) -> DataFrame:
    """jobs with candidates from frozen (source_key, candidates); a second, different freeze or an unknown job raises."""
    both = frozen.dropDuplicates().join(jobs.select("source_key", F.col("candidates").alias("had"), F.lit(True).alias("known")), "source_key", "left")
    if both.where("known IS NULL OR (had IS NOT NULL AND had <> candidates)").limit(1).count() or frozen.dropDuplicates().groupBy("source_key").count().where("count > 1").limit(1).count():
        raise Conflict("missing job or conflicting replay")
    new = frozen.dropDuplicates().select("source_key", F.col("candidates").alias("new"))
    return jobs.join(new, "source_key", "left").withColumn("candidates", F.coalesce("candidates", "new")).select(*jobs.columns)


def complete_jobs(jobs: DataFrame, keys: DataFrame) -> DataFrame:
    """jobs marked done; one without frozen candidates raises."""
    k = keys.select("source_key").distinct().withColumn("__now", F.lit(True))
    both = k.join(jobs, "source_key", "left")
    if both.where("candidates IS NULL").limit(1).count():
        raise Conflict("no frozen candidates")
    return jobs.join(k, "source_key", "left").withColumn("done", F.col("done") | F.coalesce("__now", F.lit(False))).select(*jobs.columns)


def recoverable(jobs: DataFrame, limit: int) -> DataFrame:
    """Frozen jobs that aren't done, the first by key."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return jobs.where("candidates IS NOT NULL AND NOT done").orderBy("source_key").limit(limit)


# ---------------------------------------------------------------- change queue


#: Targets up to which their list is broadcast.
BROADCAST_TARGETS = 1000


def enqueue(queue: DataFrame, memories: DataFrame, targets: DataFrame) -> DataFrame:
    """queue with an intent for every memory and target (target) that has none."""
    intent = F.concat(F.lit("projection-"), F.sha2(F.to_json(F.array("memory_id", "target")), 256))
    names = targets.select("target").distinct()
    short = names.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    one = F.lit(0).alias("one")  # an intent for each pair is what is asked for
    all_ = memories.select("memory_id", one).distinct().join((F.broadcast if short else lambda x: x)(names.select("target", one)), "one")
    new = all_.select(intent.alias("intent_id"), "memory_id", "target").join(queue.select("intent_id"), "intent_id", "left_anti")
    fill = {"operation": F.lit("upsert"), "status": F.lit("pending"), "attempts": F.lit(0), "provider_ref": F.lit(None).cast("string"), "last_error": F.lit(None).cast("string"), "generation": F.lit(0)}
    return queue.unionByName(new.withColumns(fill).select(*queue.columns))


def poll(queue: DataFrame, limit: int, target: str | None = None) -> DataFrame:
    """The next intents to do, by id."""
    if limit < 1:
        raise ValueError("limit must be positive")
    todo = queue.where("status <> 'succeeded'")
    return (todo if target is None else todo.where(F.col("target") == target)).orderBy("intent_id").limit(limit)


def requeue(queue: DataFrame, changed: DataFrame) -> DataFrame:
    """queue with the intents of changed (memory_id) pending again, a generation later for each time it changed."""
    n = changed.groupBy("memory_id").agg(F.count("*").cast("int").alias("__n"))
    hit = F.col("__n").isNotNull()
    out = queue.join(n, "memory_id", "left")
    return out.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "last_error": F.when(~hit, F.col("last_error")), "generation": F.col("generation") + F.coalesce("__n", F.lit(0))}).select(*queue.columns)


def acknowledge(queue: DataFrame, results: DataFrame) -> DataFrame:
    """queue after results (intent_id, provider_ref, error, expected_generation): an attempt more each; a success counts only for the generation it worked on."""
    one = results.select("intent_id", F.col("provider_ref").alias("__ref"), F.col("error").alias("__err"), F.col("expected_generation").alias("__gen"), F.lit(True).alias("__hit"))
    out = queue.join(one, "intent_id", "left")
    hit = F.coalesce("__hit", F.lit(False))
    done = hit & F.col("__err").isNull() & (F.col("__gen").isNull() | (F.col("__gen") == F.col("generation")))
    failed = hit & F.col("__err").isNotNull()
    return out.withColumns(
        {
            "attempts": F.col("attempts") + hit.cast("int"),
            "status": F.when(done, "succeeded").when(failed, "failed_retryable").otherwise(F.col("status")),
            "provider_ref": F.when(done, F.col("__ref")).otherwise(F.col("provider_ref")),
            "last_error": F.when(failed, F.substr("__err", F.lit(1), F.lit(1024))).when(~done, F.col("last_error")),
        }
    ).select(*queue.columns)


def run_projection(queue: DataFrame, memories: DataFrame, write, limit: int = 32, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue, results) after one bounded round. write: DataFrame of intents with their memories -> (intent_id, provider_ref, error)."""
    from memloom.stage import materialize

    todo = materialize(poll(queue, limit, target), "intents")
    joined = todo.join(memories, "memory_id", "left")
    lost = joined.where("content IS NULL").select("intent_id", F.lit(None).cast("string").alias("provider_ref"), F.lit("canonical memory missing").alias("error"))
    done = write(joined.where("content IS NOT NULL")).select("intent_id", "provider_ref", "error")
    results = materialize(done.unionByName(lost).join(todo.select("intent_id", F.col("generation").alias("expected_generation")), "intent_id"), "results")
    return acknowledge(queue, results), results
