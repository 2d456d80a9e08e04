"""Scalar expressions: times, labels, hashes, checks. All are built-in functions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An absolute time as texts state it.
STATED = r"\b(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}))?\b"
#: Requests to forget.
FORGOT = r"(?i)\bforget\b|\bforgotten\b|忘掉|忘记|忘了"
#: Statuses that a block may be said with.
STATUSES = ("confirmed", "likely", "negated", "unknown")
NO_RESPONSE = "No response requested."


def is_noise(role: Column, text: Column) -> Column:
    """System messages, background notices and the fixed answer to them."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return (role == "system") | (t == NO_RESPONSE) | t.startswith("<task-notification>")


def label(role: Column) -> Column:
    return F.when(role == "user", "User: ").otherwise("Assistant: ")


def text_parts(parts: Column) -> Column:
    """Ordered text parts of a multimodal content, empty ones dropped, a line each."""
    return F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & (F.coalesce(p["text"], F.lit("")) != "")), lambda p: p["text"]), "\n")


def estimate_tokens(text: Column) -> Column:
    """About four ASCII characters a token, and one and a half others."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    return F.floor((F.length(text) - wide) / 4 + wide / 1.5).cast("long")


def speaks_chinese(texts_cjk: Column, texts_words: Column) -> Column:
    """zh or en from summed counts of CJK characters and English words."""
    return F.when((texts_cjk > 0) & (texts_cjk >= texts_words), "zh").otherwise("en")


def count_cjk(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def count_english(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]+"))


def _stated(text: Column, bare: str) -> Column:
    days = F.regexp_extract_all(text, F.lit(STATED), F.lit(1))
    clocks = F.regexp_extract_all(text, F.lit(STATED), F.lit(2))
    each = F.zip_with(days, clocks, lambda d, c: F.try_to_timestamp(F.concat(d, F.lit(" "), F.when(c == "", bare).otherwise(c)), F.lit("yyyy-MM-dd HH:mm")))
    return F.filter(each, lambda t: t.isNotNull())


def stated_times(text: Column) -> Column:
    """Absolute times in a text; a bare date is its midnight, an impossible one is dropped."""
    return _stated(F.coalesce(text, F.lit("")), "00:00")


def stated_end(text: Column) -> Column:
    """The latest stated time; a bare date ends at 23:59."""
    return F.array_max(_stated(F.coalesce(text, F.lit("")), "23:59"))


def message_time(millis: Column, received_at: Column, idx: Column) -> Column:
    """The source's time, or else the receipt time and idx microseconds, which only orders."""
    return F.coalesce(F.timestamp_millis(millis), F.timestamp_micros(F.unix_micros(received_at) + idx))


def minute_stamp(at: Column, tz_minutes: int = 0) -> Column:
    return F.date_format(F.timestamp_micros(F.unix_micros(at) + tz_minutes * 60_000_000), "yyyy-MM-dd HH:mm")


def place_label(at: Column, session_no: Column, number: Column, session_at: Column | None = None, tz_minutes: int = 0) -> Column:
    """`YYYY-MM-DD HH:MM S# #n`; without a time the session's date, said as such."""
    where = F.when(session_no.isNotNull(), F.concat(F.lit("S"), session_no, F.lit(" #"), number))
    began = F.lit(None).cast("string") if session_at is None else F.when(at.isNull() & session_at.isNotNull(), F.concat(F.lit("session began "), F.substr(minute_stamp(session_at, tz_minutes), F.lit(1), F.lit(10))))
    return F.concat_ws(" ", minute_stamp(at, tz_minutes), F.nullif(F.concat_ws(", ", where, began), F.lit("")))


def render_source(role: Column, content: Column, at: Column, time_given: Column) -> Column:
    stamp = F.when(time_given, F.concat(F.lit(" | "), minute_stamp(at))).otherwise("")
    return F.concat(F.lit("[Original message"), stamp, F.lit("] "), role, F.lit(": "), content)


def render_memory(content: Column, at: Column, lifecycle: Column, known: Column) -> Column:
    """`[stamp| marker] content`; a memory that isn't active is marked, never hidden; an unknown time isn't shown."""
    gone = lifecycle != "active"
    stamp = F.coalesce(minute_stamp(at), F.lit("unknown time"))
    marker = "original evidence unavailable"
    return (
        F.when(known & gone, F.concat(F.lit("["), stamp, F.lit(f" | {marker}] "), content))
        .when(known, F.concat(F.lit("["), stamp, F.lit("] "), content))
        .when(gone, F.concat(F.lit(f"[{marker}] "), content))
        .otherwise(content)
    )


def status_stamp(status: Column, when: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    tail = F.when(F.trim(F.coalesce(when, F.lit(""))) != "", F.concat(F.lit("; "), F.trim(when))).otherwise("")
    return F.concat(F.lit("["), F.when(low.isin(*STATUSES), low).otherwise("unknown"), tail, F.lit("]"))


# ---------------------------------------------------------------- identities


def payload_hash(user_id: str, session_id: str, messages: list[dict]) -> str:
    """Digest of a request's content as canonical JSON; the Python twin of fingerprint columns."""
    return hashlib.sha256(json.dumps({"user_id": user_id, "session_id": session_id, "messages": messages}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def digest(*parts: Column | str) -> Column:
    """SHA-256 of parts joined by |, as deterministic identities use it."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def content_hash(text: Column) -> Column:
    """Digest of a text whose white space is collapsed."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", ""), 256)


def support_signature(refs: Column) -> Column:
    """Identity of a set of sources, whatever their order and repeats."""
    return F.concat(F.lit("support_"), F.substr(F.sha2(F.to_json(F.array_sort(F.array_distinct(refs))), 256), F.lit(1), F.lit(32)))


def scope_key(domain: Column, **ids: Column) -> Column:
    """Canonical JSON of a scope, its names sorted; null ids are left out."""
    named = {"domain": domain, **ids}
    return F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]))


def scope_is_valid(domain: Column, user_id: Column, agent_id: Column, relationship_id: Column, interaction_id: Column) -> Column:
    """The id that a domain needs is there, and no other."""
    ids = {"user": user_id, "agent": agent_id, "relationship": relationship_id, "interaction": interaction_id}
    only = [
        (domain == d) & (F.trim(own) != "") & F.greatest(*[F.when(c.isNotNull(), 1).otherwise(0) for k, c in ids.items() if k != d], F.lit(0)).eqNullSafe(0)
        for d, own in ids.items()
    ]
    world = (domain == "world") & F.coalesce(*ids.values()).isNull()
    ok = world
    for o in only:
        ok = ok | o
    return F.coalesce(ok, F.lit(False))


def question_key(text: Column) -> Column:
    """A question in lower case with its white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def local_order(point_id: Column) -> Column:
    """Sort key in which a trailing number counts as a number."""
    number = F.regexp_extract(point_id, r"([0-9]+)$", 1)
    has = number != ""
    return F.struct(
        F.when(has, F.regexp_replace(point_id, r"[0-9]+$", "")).otherwise(point_id).alias("head"),
        F.when(has, number.cast("decimal(38,0)")).otherwise(F.lit(-1).cast("decimal(38,0)")).alias("number"), point_id.alias("id"),
    )


# ---------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def vector_is_valid(v: Column, dimension: Column | int) -> Column:
    """The right length, every component finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
