"""A person's message history: order, places, session times, pending messages, windows.

messages: user_id, session_id, request_id, record_id, idx, role, content, occurred_at, seq, time_given.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.scalars import is_noise


def places(messages: DataFrame) -> DataFrame:
    """record_id, session_no (from 1, by first appearance), seq."""
    own = Window.partitionBy("user_id", "session_id")
    first = messages.withColumn("first", F.min("seq").over(own))
    return first.select("user_id", "record_id", F.dense_rank().over(Window.partitionBy("user_id").orderBy("first")).alias("session_no"), "seq")


def session_times(messages: DataFrame) -> DataFrame:
    """record_id, session_at: for rows whose time the source did not give, the last given time before them in their session."""
    before = Window.partitionBy("user_id", "session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    given = F.coalesce("time_given", F.lit(True))
    reached = F.last(F.when(given, F.col("occurred_at")), ignorenulls=True).over(before)
    return messages.withColumn("given", given).withColumn("session_at", reached).where("NOT given AND session_at IS NOT NULL").select("user_id", "record_id", "session_at")


def last_time(messages: DataFrame) -> DataFrame:
    """user_id, now: the time of each person's latest message."""
    return messages.groupBy("user_id").agg(F.max_by("occurred_at", "seq").alias("now"))


def context_before(messages: DataFrame, limit: int) -> DataFrame:
    """record_id, context: up to `limit` earlier records of the same session, oldest first."""
    w = Window.partitionBy("user_id", "session_id").orderBy("seq").rowsBetween(-max(limit, 1), -1)
    own = F.collect_list("record_id").over(w) if limit > 0 else F.expr("CAST(array() AS array<string>)")
    return messages.select("user_id", "record_id", own.alias("context"))


def pending(messages: DataFrame, windows: DataFrame) -> DataFrame:
    """Messages after the last one that a window of their user has taken."""
    done = windows.groupBy("user_id").agg(F.max("last_seq").alias("done"))
    return messages.join(done, "user_id", "left").where(F.col("seq") > F.coalesce("done", F.lit(0))).drop("done")


def pending_size(messages: DataFrame, windows: DataFrame) -> DataFrame:
    """user_id, chars, n of pending messages."""
    return pending(messages, windows).groupBy("user_id").agg(F.sum(F.length("content")).alias("chars"), F.count("*").alias("n"))


def users_with_pending(messages: DataFrame, windows: DataFrame) -> DataFrame:
    """user_id of those with pending messages or a window that isn't applied yet."""
    return pending(messages, windows).select("user_id").union(windows.where("status = 'compiled'").select("user_id")).distinct()


def characters_before(messages: DataFrame) -> DataFrame:
    """record_id, chars_before: characters that the user stored before each message."""
    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return messages.select("user_id", "record_id", F.coalesce(F.sum(F.length("content")).over(w), F.lit(0)).alias("chars_before"))


def by_request(messages: DataFrame) -> DataFrame:
    """request_id and its messages in order."""
    own = F.struct("idx", "record_id", "role", "content")
    return messages.groupBy("request_id").agg(F.array_sort(F.collect_list(own)).alias("messages"))


def touch_lines(touched: DataFrame) -> DataFrame:
    """(user_id, question, first_seen, last_active) from (user_id, question, at): the first time stays, the last one rises."""
    return touched.groupBy("user_id", "question").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_active"))


def questions(lines: DataFrame, limit: int = 50) -> DataFrame:
    """Each user's `limit` questions first seen last."""
    w = Window.partitionBy("user_id").orderBy(F.desc("first_seen"), "question")
    return lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)


# ---------------------------------------------------------------- windows


@dataclass(frozen=True)
class WindowPolicy:
    """When a compile window closes: at the first natural break from `soft` on, at `hard`, or at `max_messages`."""

    soft: int = 40
    hard: int = 80
    chars: bool = False
    gap_minutes: int = 120
    max_messages: int = 0
    work: bool = False
    assistant_head: int = 0


def _turn(previous: Column, role: Column, work: bool) -> Column:
    return (previous == "user") & (role != "user") if work else (role == "user") & (previous != "user")


def break_flags(messages: DataFrame, policy: WindowPolicy) -> DataFrame:
    """messages with `breaks`: before this message is a natural break (session, gap in given times, or turn)."""
    w = Window.partitionBy("user_id").orderBy("seq")
    lag = lambda c: F.lag(c).over(w)
    gap = lag("time_given") & F.col("time_given") & (F.unix_micros("occurred_at") - F.unix_micros(lag("occurred_at")) >= policy.gap_minutes * 60_000_000)
    breaks = (F.col("session_id") != lag("session_id")) | gap | _turn(lag("role"), F.col("role"), policy.work)
    return messages.withColumn("breaks", F.coalesce(breaks, F.lit(False)))


def counted_size(policy: WindowPolicy) -> Column:
    """What a message counts towards the caps; noise counts nothing."""
    length = F.length("content")
    if policy.assistant_head:
        length = F.when(F.col("role") == "assistant", F.least(length, F.lit(policy.assistant_head))).otherwise(length)
    return F.when(is_noise(F.col("role"), F.col("content")), 0).otherwise(length if policy.chars else 1).cast("long")


def prefix_sizes(messages: DataFrame, policy: WindowPolicy) -> DataFrame:
    """messages with `size`, and `upto`, its running sum per user."""
    w = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("size", counted_size(policy)).withColumn("upto", F.sum("size").over(w))


class _Cuts:
    """Where windows end: positions are numbers of messages, so a window from `at` to `end` holds messages at..end-1.

    Sizes are summed and breaks listed once, and each window is found by bisection.
    """

    def __init__(self, sizes: list[int], breaks: list[bool], policy: WindowPolicy) -> None:
        self.upto = [0, *accumulate(sizes)]
        self.breaks = [i for i, b in enumerate(breaks) if b]
        self.n, self.policy = len(sizes), policy

    def _break_in(self, low: int, high: int, last: bool) -> int | None:
        """The first or last natural break at one of the positions low..high."""
        a, b = bisect_left(self.breaks, low), bisect_right(self.breaks, high)
        return (self.breaks[b - 1] if last else self.breaks[a]) if a < b else None

    def end(self, at: int, final: bool) -> int | None:
        """The end of the window that starts at `at`; None: wait for more."""
        p, start = self.policy, self.upto[at]
        full = bisect_right(self.upto, start + p.hard) - 1  # the last end within the hard cap
        most = min(full, at + p.max_messages) if p.max_messages else full
        enough = max(bisect_left(self.upto, start + p.soft, at), at + 1)
        natural = self._break_in(enough, min(most, self.n - 1), last=False)
        if natural is None and p.max_messages and self.n - at > p.max_messages:
            late = self._break_in(at + max(p.max_messages // 2, 1), most, last=True)
            return max(most, at + 1) if late is None else late
        if natural is None and self.n > at and self.upto[-1] - start >= p.hard:
            return max(full, at + 1)
        return natural if natural is not None else self.n if final and self.n > at else None


def next_cut(sizes: list[int], breaks: list[bool], policy: WindowPolicy, final: bool) -> int | None:
    """How many of the pending messages the next window takes; None: wait for more.

    sizes, breaks: per pending message; breaks[i] says that a natural break lies before message i.
    """
    return _Cuts(sizes, breaks, policy).end(0, final)


def all_cuts(sizes: list[int], breaks: list[bool], policy: WindowPolicy, final: bool = True) -> list[tuple[int, int]]:
    """(first, end) of every window that closes, one after the other."""
    cuts, out, at = _Cuts(sizes, breaks, policy), [], 0
    while at < len(sizes) and (end := cuts.end(at, final)) is not None:
        out.append((at, end))
        at = end
    return out


def cut_windows(messages: DataFrame, policy: WindowPolicy, final: bool = True, max_chars_per_user: int = 0) -> DataFrame:
    """(user_id, window_id, first_seq, last_seq, n, size, raw_only): each user's messages cut into windows.

    A cut resets the sizes, so this is an ordered fold; each group holds one user's narrow rows (no texts). raw_only: the
    window starts past max_chars_per_user of the user's history.
    """
    rows = break_flags(messages, policy).select("user_id", "seq", "breaks", counted_size(policy).alias("size"), F.length("content").alias("length"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq").reset_index(drop=True)
        before = f["length"].cumsum() - f["length"]
        out = [
            {
                "user_id": f["user_id"][0], "window_id": f"{f['user_id'][0]}:w{f['seq'][a]}", "first_seq": f["seq"][a], "last_seq": f["seq"][b - 1],
                "n": b - a, "size": int(f["size"][a:b].sum()), "raw_only": bool(max_chars_per_user and before[a] >= max_chars_per_user),
            }
            for a, b in all_cuts(f["size"].tolist(), f["breaks"].tolist(), policy, final)
        ]
        return pd.DataFrame(out, columns=["user_id", "window_id", "first_seq", "last_seq", "n", "size", "raw_only"])

    return rows.groupBy("user_id").applyInPandas(fold, "user_id string, window_id string, first_seq long, last_seq long, n long, size long, raw_only boolean")


def tail_start(roles: list[str], work: bool = True) -> int | None:
    """Where a window's unfinished end starts: work, an unanswered run of the agent; chat, the person's last words, if an assistant is there."""
    people = [i for i, r in enumerate(roles) if r == "user"]
    if work:
        return people[-1] + 1 if people and people[-1] < len(roles) - 1 else None
    others = [i for i, r in enumerate(roles) if r != "user"]
    if "assistant" not in roles or not people or people[-1] != len(roles) - 1:
        return None
    return others[-1] + 1 if others else 0


def gap_sessions(events: DataFrame, gap_minutes: int = 120) -> DataFrame:
    """(user_id, session_no, n, started, ended) of events (user_id, ts, event_id) that are under the gap apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce(F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= gap_minutes * 60_000_000, F.lit(True))
    numbered = events.withColumn("new", new.cast("int")).withColumn("session_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def split_units(messages: DataFrame, most_bytes: int = 16_000) -> DataFrame:
    """(unit_id, user_id, record_id, occurred_at, text): role-prefixed pieces of messages, each text once per request, numbered in order."""
    from memloom.functions.scalars import label
    from memloom.functions.text import split_bytes_udf

    whole = F.concat(label(F.col("role")), F.coalesce("content", F.lit("")))
    long = F.octet_length(whole) > most_bytes
    short = messages.where(~long).withColumn("pieces", F.array(whole))
    cut = messages.where(long).withColumn("pieces", split_bytes_udf(whole, F.lit(most_bytes)))
    each = short.unionByName(cut).select("request_id", "user_id", "record_id", "idx", "occurred_at", F.posexplode("pieces").alias("k", "text"))
    first = each.withColumn("__n", F.row_number().over(Window.partitionBy("request_id", "text").orderBy("idx", "k"))).where("__n = 1")
    number = F.row_number().over(Window.partitionBy("request_id").orderBy("idx", "k")) - 1
    return first.select(F.concat(F.lit("raw:"), "request_id", F.lit(":"), number).alias("unit_id"), "user_id", "record_id", "occurred_at", "text")


def backfill_time_given(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """messages whose unknown time_given is inferred: a time a second or more from the request's receipt was given by the source."""
    got = requests.select("request_id", "received_at")
    far = F.abs(F.unix_micros("occurred_at") - F.unix_micros("received_at")) >= 1_000_000
    return messages.join(got, "request_id", "left").withColumn("time_given", F.coalesce("time_given", F.coalesce(far, F.lit(True)))).drop("received_at")

