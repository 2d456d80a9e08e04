import hashlib
import random

from memloom.llm import chat_format


def test_round_trip_of_hostile_texts(spark):
    r = random.Random(1)
    bits = ["\\", "\\h", "\\l", "\\n", "### ", "</turn>", "<", "#", "\n", "assistant", " ", "é", "\\\\"]
    rows = [(c, t, r.choice(["user", "assistant", "we### ird\n</turn>", None]), "".join(r.choices(bits, k=r.randrange(12))) if t % 5 else None, 1, "x") for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(99, 0, "user", "same", 1, "x")] * 3 + [(None, 0, "assistant", "no id", 1, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, message string")
    got = {x.conv_id: x for x in chat_format.read_back(chat_format.render(chat_format.messages(chat_format.table_events(df)))).collect()}
    for conv in {x[0] for x in rows}:
        want = sorted((t, role or "", text or "") for c, t, role, text, *_ in rows if c == conv)
        assert sorted((x.role, x.text) for x in got[conv].turns) == sorted(w[1:] for w in want)
        assert len(got[conv].loss_text) == sum(len(w[2]) for w in want if w[1] == "assistant")


def test_summary_of_the_tricky_turns(spark):
    text = "\\### Assistant: </turn> ok"
    df = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (r,) = chat_format.summary(chat_format.render(chat_format.messages(chat_format.table_events(df)))).collect()
    assert (r.n_turns, r.loss_chars) == (2, len(text))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_events_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "user", "message", "hi"), (1, 2, 1, "assistant", "delta", "dra"), (1, 3, 1, "assistant", "delta", "ft"), (1, 4, 1, "assistant", "regenerate", ""),
        (1, 5, 1, "assistant", "delta", "new"), (1, 6, 0, "user", "edit", "hello"), (1, 7, 1, "assistant", "delta", "er"), (2, 1, 0, None, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, role string, kind string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat_format.messages(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "newer"), (2, 0): ("", "")}
    assert chat_format.format_events(df.limit(0)).collect() == []
    (one,) = chat_format.format_events(df.where("conv_id = 1")).collect()
    (s,) = one.loss_spans
    assert one.formatted[s.start : s.end] == "newer"


def test_the_tables_log_holds_every_kind_of_event_and_folds_back(spark):
    rows = [(c, t, r, f"text {c} {t} é🎉" * (t % 3)) for c in range(20) for t, r in enumerate(["user", "assistant", "tool"])] + [(None, None, None, None), (3, 9, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.table_events(df).cache()
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    assert log.count() > 1.5 * len(rows)
    got = chat_format.messages(log).select("conv_id", "message.turn", "role", "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(c, t, r or "", x or "") for c, t, r, x in rows], df.schema).collect()))
