"""Messages as a stream: the same window cut as in batch, as state per user.

Arrival order decides, nothing is late: there is no watermark. A user's tail that stays idle is closed by a processing-time timer.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.operators.history import WindowPolicy, all_cuts, counted_size

CLOSED = "user_id string, window_id string, first_seq long, last_seq long, n long, size long"
_FIELDS = ["seq", "session_id", "role", "at", "given", "size"]


def _breaks(rows: list[list], policy: WindowPolicy) -> list[bool]:
    out = [False]
    for (_, s0, r0, t0, g0, _), (_, s1, r1, t1, g1, _) in zip(rows, rows[1:]):
        turn = (r0 == "user" and r1 != "user") if policy.work else (r1 == "user" and r0 != "user")
        out.append(s0 != s1 or (g0 and g1 and t1 - t0 >= policy.gap_minutes * 60_000_000) or turn)
    return out


def close(user: str, rows: list[list], policy: WindowPolicy, final: bool) -> tuple[list[dict], list[list]]:
    """(windows that close, rows still pending)."""
    cuts = all_cuts([r[5] for r in rows], _breaks(rows, policy), policy, final)
    closed = [{"user_id": user, "window_id": f"{user}:w{rows[a][0]}", "first_seq": rows[a][0], "last_seq": rows[b - 1][0], "n": b - a, "size": sum(r[5] for r in rows[a:b])} for a, b in cuts]
    return closed, rows[cuts[-1][1] if cuts else 0 :]


def window_stream(messages: DataFrame, policy: WindowPolicy, idle_ms: int = 0) -> DataFrame:
    """Closed windows (CLOSED) of a message stream. idle_ms > 0: a user without messages for that long has the tail closed."""
    own = messages.select("user_id", "seq", "session_id", "role", F.unix_micros("occurred_at").alias("at"), F.col("time_given").alias("given"), counted_size(policy).alias("size"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = json.loads(state.get[0]) if state.exists else []
        for b in batches:
            rows += [[int(r.seq), r.session_id, r.role, int(r.at), bool(r.given), int(r.size)] for r in b.itertuples(index=False)]
        rows.sort()
        closed, rest = close(key[0], rows, policy, final=state.hasTimedOut)
        if rest:
            state.update((json.dumps(rest),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(closed, columns=["user_id", "window_id", "first_seq", "last_seq", "n", "size"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return own.groupBy("user_id").applyInPandasWithState(fold, CLOSED, "pending string", "append", timeout)


def flush(messages: DataFrame, closed: DataFrame, policy: WindowPolicy) -> DataFrame:
    """What a stream left open, closed as a batch: everything after each user's last closed window."""
    from memloom.operators.history import cut_windows, pending

    return cut_windows(pending(messages, closed), policy, final=True).drop("raw_only")


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """One row a key: the smallest by all columns, in their order, so that every run keeps the same one."""
    least = F.min(F.struct(*[F.col(c) for c in rows.columns])).alias("row")
    return rows.groupBy(key).agg(least).select("row.*")


def first_wins_sink(path: str, key: str = "window_id"):
    """A foreachBatch writer that appends rows under new keys only, so a repeated batch changes nothing; of a batch's rows of one key the smallest stays."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        new = first_of(batch, key)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return write


def over_limit(pending_sizes: DataFrame, max_chars: int, max_messages: int) -> DataFrame:
    """Users whose backlog (user_id, chars, n) should hold further requests back: more than max_chars, or twice max_messages."""
    return pending_sizes.where((F.col("chars") > max_chars) | (F.lit(max_messages > 0) & (F.col("n") > 2 * max_messages)))
