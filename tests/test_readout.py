import datetime as dt

import pytest

from memloom.operators.readout import Bundle, Message, Policy, Step, compose, label, within

T = dt.datetime(2024, 1, 2, 9, 0)


def bundle(**more):
    steps = {
        "a": Step("choose a laptop [confirmed]", T, True, (1, 1), sources=["r1"], relevance=0.9),
        "b": Step("ask for the price\nmore", T, False, (1, 2), sources=["r2"], relevance=0.5),
        "c": Step("buy it [likely; soon]", T, False, (2, 5), ((3, 9),), sources=["r3"], relevance=0.7),
    }
    messages = {f"r{i}": Message(f"words {i}", "user" if i != 2 else "assistant", T, (1, i)) for i in range(1, 6)}
    base = dict(ranked=["a", "c"], raw=["r1", "r4"], steps=steps, messages=messages, parents={"b": ["a"], "c": ["b"]}, blocks_of={"r1": ["a"], "r2": ["b"], "r3": ["c"]}, uncompiled=["r4"], pool=["r1", "r4", "r5"])
    return Bundle(**{**base, **more})


def test_one_piece_with_words_under_their_steps():
    items = compose(bundle(), Policy(raw_fill=2))
    assert [i["id"] for i in items] == ["line:a", "raw:r4", "raw:r5"]
    rows = items[0]["content"].split("\n")
    assert rows[0] == "[A line]"
    assert rows[1] == "[2024-01-02 09:00 S1 #1] choose a laptop [confirmed]" and rows[2] == "[2024-01-02 09:00 S1 #1 Person] words 1"
    assert "[2024-01-02 09:00 S1 #2 not confirmed] ask for the price" in rows
    assert "[2024-01-02 09:00 S2 #5] buy it [likely; soon] (later settled, see S3 #9)" in rows
    assert items[1]["content"] == "[Raw excerpts]\n[2024-01-02 09:00 S1 #4 Person] words 4"
    assert items[2]["content"].startswith("[Other raw messages")


def test_standing_first_and_forget_apart():
    b = bundle(standing=["s1", "s2"])
    b.steps |= {"s1": Step("be brief", T, True, (1, 1)), "s2": Step("forget my address", T, True, (1, 2))}
    first = compose(b, Policy(forget_scope=True))[0]
    assert first["id"] == "standing" and first["content"].split("\n")[0] == "[Standing instructions and preferences]"
    assert first["content"].split("\n")[2].startswith("[What the person asked to be forgotten")
    assert first["score"] == 3.0


def test_marks_told_and_stretches():
    plain = compose(bundle(), Policy(marks=False))[0]["content"]
    assert "[confirmed]" not in plain and "not confirmed" not in plain
    told = compose(bundle(), Policy(assistant="told"))[0]["content"]
    assert "  - [2024-01-02 09:00 S1 #2 Agent told the person] ask for the price" in told.split("\n")
    items = compose(bundle(stretches={"t": {"summary": "the laptop", "members": ["a", "b", "c"]}}), Policy(thread_k=1, thread_span=True))
    assert items[0]["id"] == "thread:t" and items[0]["content"].split("\n")[1] == "[2024-01-02 09:00 S1 #1 - 2024-01-02 09:00 S2 #5] the laptop"


def test_budgets():
    b = bundle(raw=[], uncompiled=[])
    lists = Policy(raw_under_sb=False)
    assert "[The words of these steps]" in compose(b, lists)[0]["content"]
    assert "[The words of these steps]" not in compose(b, Policy(raw_under_sb=False, sb_raw_chars=5))[0]["content"]
    small = compose(b, Policy(raw_under_sb=False, readout_tokens=1))
    assert "[The words of these steps]" not in small[0]["content"]
    with pytest.raises(ValueError):
        Policy(assistant="odd")


def test_code_seen_before_is_given_as_changes():
    old = "```py\na = 1\nb = 2\nc = 3\n```"
    b = bundle(ranked=["x"], raw=[], uncompiled=["k1", "k2"], steps={"x": Step("code", T, True, (1, 1))}, parents={})
    b.messages = {"k1": Message(old, "user", T, (1, 1)), "k2": Message(old.replace("b = 2", "b = 5"), "user", T, (1, 2))}
    items = compose(b, Policy(code_diff=True))
    assert "# changes from S1 #1 (- removed, + added)\n-b = 2\n+b = 5\n```" in items[-1]["content"]


def test_labels_and_eviction():
    assert label(T, 480, (1, 2)) == "2024-01-02 17:00 S1 #2"
    assert label(None, 0, (1, 2), T) == "S1 #2, session began 2024-01-02" and label(None, 0, None, T, "zh") == "会话始于 2024-01-02"
    items = [{"id": x} for x in ("standing", "thread:1", "thread:2", "line:a", "raw:1")]
    assert [i["id"] for i in within(items, 4)] == ["standing", "thread:1", "line:a", "raw:1"]
    assert [i["id"] for i in within(items, 2)] == ["standing", "line:a"]


def test_the_whole_plan_runs(spark):
    from memloom import catalogue

    items = catalogue.flagship(spark, "/root/testdata/sf0.001").collect()
    assert items and {i.kind for i in items} <= {"line", "source"}


def _history(rng, n=60):
    """Tables of one person's random history, and the whole of it as a Bundle, nothing left out."""
    import json

    texts = ["said nothing", "forget my address", "bought it [confirmed]", "code\nmore lines", "may go [likely; soon]", ""]
    blocks, messages, edges = [], [], []
    for i in range(n):
        at = T + dt.timedelta(minutes=i) if i % 3 else None
        sources = [f"r{i}"] + ([f"r{i - 1}"] if i % 4 == 3 else [])
        spans = {f"r{i}": [1]} if i % 5 == 0 else {}
        pointers = {"own": {f"r{i}": [[0, 4]]}, "parts": [], "chars": True} if i % 7 == 1 else None
        later = [(2, 5)] if i % 6 == 2 else None
        blocks.append((f"b{i:02}", f"{rng.choice(texts)}", at, i % 2 == 0, i // 10, i, sources, later, T, json.dumps(spans), json.dumps(pointers)))
        messages.append((f"r{i}", f"first words {i}\n\nsecond words {i}", "user" if i % 2 else "assistant", T + dt.timedelta(minutes=i), bool(i % 3), i // 10, i, T))
        if i and i % 10:
            edges.append((f"b{rng.randrange(i // 10 * 10, i):02}", f"b{i:02}"))
    return blocks, messages, edges


@pytest.mark.parametrize("seed", range(3))
def test_readout_equals_composing_the_whole_history(spark, seed):
    import json
    import random

    import numpy as np

    from memloom.operators.readout import readout

    rng = random.Random(seed)
    blocks, messages, edges = _history(rng)
    names = [b[0] for b in blocks]
    vec = lambda: [float(rng.randrange(-3, 4)) for _ in range(4)]
    asked = {q: vec() for q in ("q1", "q2", "q3")}
    known = {b: vec() for b in names if b != "b05"}
    stretches = {f"t{k}": {"summary": f"stretch {k}", "members": names[k * 10 : k * 10 + 10] + (names[:1] if k else [])} for k in range(6)}
    standing = {"q1": ["b01", "b31"], "q2": ["b59"]}
    ranked = {q: rng.sample(names, 8) for q in asked}
    pool = {q: [f"r{i}" for i in rng.sample(range(60), 8)] for q in ("q1", "q2")}
    raw = {q: rng.sample(x, 6) for q, x in pool.items()}
    policy = Policy(raw_k=5, sbs=3, raw_fill=8, hit_anchors=True, reach=2, gap=1, extend=4, thread_k=2, thread_sbs=3, thread_span=True, forget_scope=True)

    def close(q, b):
        v, w = np.array(asked[q]), np.array(known.get(b, [0.0] * 4))
        return float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w) or 1)

    def whole(q):
        own = {}
        for b in blocks:
            for r in b[6]:
                own.setdefault(r, []).append(b[0])
        up = {}
        for p, c in sorted(edges):
            up.setdefault(c, []).append(p)
        heard = raw.get(q, [])[: policy.raw_k]
        steps = {b[0]: Step(b[1], b[2], b[3], (b[4], b[5]), tuple(b[7] or ()), None if b[2] else b[8], b[6], json.loads(b[9]), json.loads(b[10]), close(q, b[0])) for b in blocks}
        told = {m[0]: Message(m[1], m[2], m[3] if m[4] else None, (m[5], m[6]), None if m[4] else m[7]) for m in messages}
        best = [min(own[r], key=lambda b: (-steps[b].relevance, b)) for r in heard]
        home = {q: v for q, v in stretches.items()}
        return Bundle(ranked[q], heard, steps, told, up, standing.get(q, []), home, own, pool.get(q, []), [r for r in heard if r not in own], best)

    def listed(d):
        return spark.createDataFrame([(q, n, x) for q, xs in d.items() for n, x in enumerate(xs, 1)], "question_id string, rank int, id string")

    tables = (
        spark.createDataFrame(blocks, "block_id string, text string, occurred_at timestamp, past boolean, session_no int, seq long, sources array<string>, later array<struct<session_no:int,seq:long>>, session_at timestamp, spans string, pointers string"),
        spark.createDataFrame(messages, "record_id string, content string, role string, occurred_at timestamp, time_given boolean, session_no int, seq long, session_at timestamp"),
        spark.createDataFrame(edges, "parent string, child string"),
    )
    got = readout(
        listed(ranked), listed(raw), *tables, policy, standing=listed(standing).drop("rank"), pool=listed(pool), languages=spark.createDataFrame([("q2", "zh")], "question_id string, lang string"),
        stretches=spark.createDataFrame([(k, v["summary"], v["members"]) for k, v in stretches.items()], "stretch_id string, summary string, members array<string>"),
        vectors=(spark.createDataFrame(list(asked.items()), "question_id string, vector array<double>"), spark.createDataFrame(list(known.items()), "block_id string, vector array<double>")),
    ).collect()
    for q in asked:
        want = [(i["id"], i["content"], i["score"]) for i in within(compose(whole(q), policy, "zh" if q == "q2" else "en"), 100)]
        assert [(r.id, r.content, r.score) for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.place)] == want


def test_a_passage_finds_what_the_question_does_not(spark):
    from pyspark.sql import functions as F

    from memloom.plans.search import line_readout

    told = [("r1", "the red apple", 1), ("r2", "a green pear", 2), ("r3", "one more apple", 3)]
    messages = spark.createDataFrame([(r, c, "user", T, True, 1, n) for r, c, n in told], "record_id string, content string, role string, occurred_at timestamp, time_given boolean, session_no int, seq long")
    units = messages.select(F.lit("u").alias("scope"), F.col("record_id").alias("id"), "record_id", F.col("content").alias("text"))
    blocks = messages.select(F.lit("u").alias("scope"), F.concat(F.lit("b:"), "record_id").alias("block_id"), F.col("content").alias("text"), "occurred_at", F.lit(True).alias("past"), "session_no", "seq", F.array("record_id").alias("sources"))
    edges = spark.createDataFrame([], "parent string, child string")
    asked = spark.createDataFrame([("q", "u", "apple")], "question_id string, scope string, text string")
    passage = lambda text: spark.createDataFrame([("q", "u", text)], "question_id string, scope string, text string")
    ids = lambda **more: sorted(r.id for r in line_readout(asked, units, blocks, messages, edges, **more).collect())
    alone = ids()
    assert alone == ["line:b:r1", "line:b:r3"]
    assert ids(passages=passage("green pear")) == [*alone[:1], "line:b:r2", *alone[1:]]
    assert ids(passages=passage(" ")) == alone
    stands = spark.createDataFrame([("u", "b:r2"), ("other", "b:r1")], "scope string, block_id string")
    assert ids(standing=stands) == [*alone, "standing"]
