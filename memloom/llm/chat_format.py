"""Chat formatting from an event log: reconstruct the final messages, then render them with a loss mask.

Events: conv_id, seq, message (orders the turns of a conversation), role, kind, text. Kinds:
  message, edit, regenerate  set the message's text anew
  delta                      appends to it
so a message's final text is its last setting event's text and the deltas after it; `seq`
orders the events. Everything is DataFrame functions.

A turn is rendered as `### role`, newline, text, `</turn>`, newline. In texts and roles the
backslash and the control strings are escaped: `\\` as `\\\\`, `### ` as `\\h## `, `</turn>` as
`\\l/turn>`, and in roles also the newline as `\\n`. Rendered text holds none of the control
strings but the template's own, so `read_back` inverts it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
KINDS = ("message", "edit", "regenerate", "delta")


def escape(x: Column, role: bool = False) -> Column:
    for a, b in (("\\", "\\\\"), (HEAD, "\\h## "), (END, "\\l/turn>"), *((("\n", "\\n"),) if role else ())):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column, role: bool = False) -> Column:
    def piece(p: Column) -> Column:
        for a, b in (("\\h", "#"), ("\\l", "<"), *((("\\n", "\n"),) if role else ())):
            p = F.replace(p, F.lit(a), F.lit(b))
        return p

    return F.array_join(F.transform(F.split(x, r"\\\\", -1), piece), "\\")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the state after folding each message's events by seq.

    Null seq sorts first, ties go by kind, then text; a null or unknown kind counts as `message`, a null text as
    empty; repeated events of kind delta append as often as they occur. The role is that of the last setting event.
    """
    kind = F.when(F.col("kind") == "delta", 1).otherwise(0).alias("add")
    each = events.select(
        "conv_id", "message",
        F.struct(F.col("seq").cast("long").alias("seq"), kind, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")).alias("e"),
    )
    log = each.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list("e")).alias("log"))
    sets = F.transform("log", lambda e, i: F.when(e["add"] == 0, i + 1).otherwise(0))
    last = F.greatest(F.array_max(sets), F.lit(1))
    return log.withColumn("last", last).select(
        "conv_id", "message",
        F.element_at("log", F.col("last")).getField("role").alias("role"),
        F.array_join(F.transform(F.slice("log", F.col("last"), F.size("log")), lambda e: e.text), "").alias("text"),
    )


def render(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end in code points; the texts of role `learn`).

    turns: conv_id, message, role, text, ordered by message, then role and text; a null conv_id is a conversation of its own.
    A conversation is one output row, so its turns meet in one task; nothing wider does.
    """
    esc = turns.select("conv_id", "message", escape(F.col("role"), role=True).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == learn).alias("learn"))
    fixed = len(HEAD + "\n" + END + "\n")
    size = F.length("role").cast("long") + F.length("text") + fixed
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text")
    place = F.struct("message", "role", "text", "learn", F.row_number().over(order).alias("n"), F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    conv = esc.select("conv_id", place.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t.n").alias("n"), F.col("t").alias("t")))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda x: F.concat(F.lit(HEAD), x.t.role, F.lit("\n"), x.t.text, F.lit(END + "\n"))), "")
    stop = lambda x: x.t.stop - len(END + "\n")
    spans = F.transform(F.filter("ts", lambda x: x.t.learn), lambda x: F.struct((stop(x) - F.length(x.t.text)).alias("start"), stop(x).alias("end")))
    return conv.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text as before escaping), loss_text, formatted: from the rendered text and its loss mask alone."""
    mark = END + "\n"
    parts = F.filter(F.split(F.col("formatted"), mark, -1), lambda p: p != "")  # what follows the last mark is empty
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), "\n", 1), role=True).alias("role"),
        unescape(F.substr(p, F.position(F.lit("\n"), p) + 1)).alias("text"),
    )
    masked = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def format_events(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """messages, then render. An empty log gives no rows; other columns of events are ignored."""
    return render(messages(events.repartition("conv_id")), learn)


def table_events(conversations: DataFrame) -> DataFrame:
    """The table's rows as the event log of a chat service, whose fold gives the table back; events of a row come in no order.

    By a hash of the row it was sent whole; streamed in deltas; drafted otherwise and edited; or streamed wrongly and
    regenerated. Repeated rows of one turn are turns of their own, so each row's place among its repeats is part of
    `message`; a null turn comes first, a null text is empty; an empty table gives no events.
    """
    again = F.row_number().over(Window.partitionBy("conv_id", "turn", "role", "text").orderBy(F.lit(0)))
    rows = conversations.repartition("conv_id").select(
        "conv_id", F.struct("turn", "role", "text", again.alias("again")).alias("message"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.pmod(F.coalesce(F.col("turn").cast("long"), F.lit(0)), F.lit(1 << 40)) * 8).alias("first"), F.pmod(F.xxhash64("turn", "role", "text"), F.lit(4)).alias("how"),
    )
    third = F.floor(F.length("text") / 3).cast("int")
    parts = [F.substr("text", F.lit(1), third), F.substr("text", third + 1, third), F.substr("text", 2 * third + 1)]
    wrong = F.concat(F.lit("draft "), F.reverse("text"))

    def event(step: int, kind: str, text: Column, role: Column) -> Column:
        return F.struct((F.col("first") + step).alias("seq"), role.alias("role"), F.lit(kind).alias("kind"), text.alias("text"))

    own, other, none = F.col("role").cast("string"), F.lit("draft"), F.lit(None).cast("string")
    log = (
        F.when(F.col("how") == 0, F.array(event(0, "message", F.col("text"), own)))
        .when(F.col("how") == 1, F.array(event(2, "delta", parts[2], none), event(0, "message", parts[0], own), event(1, "delta", parts[1], none)))
        .when(F.col("how") == 2, F.array(event(1, "edit", F.col("text"), own), event(0, "message", wrong, other)))
        .otherwise(F.array(
            event(4, "delta", F.concat(parts[1], parts[2]), none), event(1, "delta", wrong, none), event(3, "delta", parts[0], none),
            event(2, "regenerate", F.lit(""), own), event(0, "message", F.lit(""), other),
        ))
    )
    return rows.select("conv_id", "message", F.explode(log).alias("e")).select("conv_id", "message", "e.*")


def summary(formatted: DataFrame) -> DataFrame:
    """What read_back gives, as counts and digests."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
