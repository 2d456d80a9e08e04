import json
import random

import pytest

from memloom.operators import evaluate, parsers


def test_json_in_answers():
    assert parsers.answer_array('analysis [x]\nJSON:\n[{"a": 1}]') == [{"a": 1}]
    assert parsers.answer_array('```json\n[1]\n```') == [1]
    assert parsers.json_array('[{\n"text": "say "hi" now",\n"n": 1\n}]') == [{"text": 'say "hi" now', "n": 1}]
    assert parsers.json_object('x {"a": {"b": 1}} y') == {"a": {"b": 1}}
    with pytest.raises(ValueError):
        parsers.json_array("none")
    assert parsers.answered_messages("STOP: M3 STOP: M9", 5) == 5 and parsers.answered_messages("no", 5) == 5 and parsers.answered_messages("STOP: M2", 5) == 2


def test_situation_and_move():
    for s, m in (("a", "b"), ("", "b"), ("a", "")):
        for lang in ("en", "zh"):
            assert parsers.parted(parsers.joined(s, m, lang)) == (s, m)


def test_work_blocks():
    roles = ["assistant", "user", "assistant", "user"]
    data = {"moves": [{"msg": "M4", "about": ["M3", "M1", "M9", "M2"], "situation": "s", "move": "go", "happened": False}, {"msg": "M2", "move": "yes"}, {"msg": "M1", "move": "x"}, {"msg": "M4", "move": " "}, "odd"]}
    got = parsers.work_blocks(data, roles, ["a", "a", "b", "b"])
    assert [(b["sources"], b["move"], b["happened"]) for b in got] == [([1], "yes", True), ([2, 3], "go", False)]
    with pytest.raises(ValueError):
        parsers.check_work({"moves": []}, roles)
    with pytest.raises(ValueError):
        parsers.work_blocks({"moves": 1}, roles)


def test_chat_blocks_nest_drop_and_point():
    texts = ["I want a laptop. The red one is too dear.", "ok", "code\n\n```\nx = 1\n```\n\nplease run it"]
    roles = ["user", "assistant", "user"]
    data = [
        {"turns": "M1", "text": "laptop", "status": "confirmed", "from": "I want", "to": "laptop.", "next": [{"turns": "", "text": "dropped", "next": [{"turns": "M1", "text": "red", "from": "The red", "to": "dear."}]}]},
        {"turns": "M2", "text": "told", "status": "confirmed"}, {"turns": "M3.3", "text": "run", "status": "odd", "standing": "true"},
    ]
    got = parsers.chat_blocks(data, roles, [1, 1, 3], texts)
    by = {b["situation"].split(" ")[0]: b for b in got}
    assert by["red"]["under"] == got.index(by["laptop"]) and by["laptop"]["under"] is None
    assert [texts[0][a:b] for a, b in by["red"]["pointers"]["own"][0]] == ["The red one is too dear."]
    assert by["told"]["situation"] == "told [unknown]" and not by["told"]["happened"] and by["laptop"]["happened"]
    own = by["run"]["pointers"]["own"][2]
    assert [texts[2][a:b] for a, b in own] == ["```\nx = 1\n```", "please run it"] and by["run"]["standing"]
    assert [b["under"] for b in parsers.before(got, 1)] == [b["under"] for b in got if b["sources"] == [0]]
    parsers.check_chat([], roles)
    with pytest.raises(ValueError):
        parsers.check_chat([{"turns": "M9", "text": "x"}], ["user", "user", "user"])


def test_stretches():
    ok = parsers.stretches({"stretches": [{"sbs": "o1-s1", "closed": True, "summary": "one"}, {"sbs": "s2-s3", "from": "T2", "closed": False}], "settles": {"s2": ["N1", "N9"], "x": "N1"}}, 3, 2, 1, 2)
    assert ok == {"stretches": [{"sbs": [0], "joins_open": True, "from": None, "closed": True, "summary": "one"}, {"sbs": [1, 2], "joins_open": False, "from": 1, "closed": False, "summary": ""}], "open_summary": "", "settles": {1: [0]}}
    alone = parsers.stretches({"stretches": [{"sbs": "o1-o2", "summary": "was"}, {"sbs": "s1-s3"}]}, 3, 0, 0, 2)
    assert alone["open_summary"] == "was" and alone["stretches"][0]["joins_open"] is False
    for bad in ([{"sbs": "s1-s2"}], [{"sbs": "s2-s3"}], [{"sbs": "s1-s3", "closed": True}], [{"sbs": "?"}], ["x"], [{"sbs": "o1"}, {"sbs": "o2-s3"}]):
        with pytest.raises(ValueError):
            parsers.stretches({"stretches": bad}, 3, 0, 0, 2 if bad[0] == {"sbs": "o1"} else 0)
    placed = parsers.place_stretches(ok, ["x", "y", "z"], "t:open", "old", [("t:1", "p"), ("t:2", "q")])
    assert placed == {"home": {"x": "t:open", "y": "t:y", "z": "t:y"}, "after": {"x": "old", "y": "q", "z": "y"}, "summaries": {"t:open": "one", "t:y": ""}, "origins": {"t:y": {"stretch": "t:2", "step": "q"}}}


def point(i, **more):
    return {"point_id": i, "meaning": f"m {i}", "status": "resolved", "speech_act": "assertion", "polarity": "positive", "epistemic_status": "asserted", "temporal_scope": "current", **more}


def edge(a, b, **more):
    return {"from_point_id": a, "target_kind": "point", "target_id": b, "relation": "r", "boundary_policy": "cohabit", "lifecycle_effect": "none", **more}


def delta(points, edges):
    return {"schema_version": parsers.SCHEMA_VERSION, "points": points, "dependencies": edges}


def test_closure_is_the_same_for_any_order():
    points = [point(f"p{i}") for i in (10, 9, 2, 1)] + [point("d", status="defer")]
    edges = [edge("p10", "p9"), edge("p9", "p2"), edge("p1", "mem", target_kind="memory", boundary_policy="context", lifecycle_effect="supersede")]
    want = parsers.close_delta(delta(points, edges), ("mem",))
    assert [b["member_point_ids"] for b in want] == [["p1"], ["p2", "p9", "p10"]]
    assert want[0]["context_memory_ids"] == ["mem"] and want[1]["analysis_text"] == "m p2\nm p9\nm p10"
    r = random.Random(0)
    for _ in range(10):
        p, e = r.sample(points, len(points)), r.sample(edges * 2, len(edges) * 2)
        assert parsers.close_delta(json.dumps(delta(p, e)), ("mem",)) == want


@pytest.mark.parametrize(
    ("payload", "code"),
    [
        ('{"a": 1, "a": 2}', parsers.INVALID), ("{", parsers.INVALID), (delta([point("p", extra=1)], []), parsers.INVALID), (delta([point("p"), point("p")], []), parsers.INVALID), (delta([point("p", polarity="odd")], []), parsers.INVALID),
        (delta([point(" ")], []), parsers.INVALID), ('{"schema_version": NaN}', parsers.INVALID), (delta([point("p")], [edge("x", "p")]), parsers.NO_POINT), (delta([point("p")], [edge("p", "x")]), parsers.NO_POINT),
        (delta([point("p"), point("q", status="defer")], [edge("p", "q")]), parsers.BAD_EDGE), (delta([point("p"), point("q")], [edge("p", "q", lifecycle_effect="supersede")]), parsers.BAD_EDGE),
        (delta([point("p")], [edge("p", "m", target_kind="memory")]), parsers.BAD_EDGE), (delta([point("p")], [edge("p", "m", target_kind="memory", boundary_policy="context")]), parsers.NO_MEMORY),
    ],
)
def test_deltas_are_refused_whole(payload, code):
    with pytest.raises(parsers.DeltaError) as e:
        parsers.semantic_delta(payload)
    assert e.value.code == code


def test_statistics(spark):
    rows = [(arm, str(i), bool((i * k) % 3), None, "x" if i % 2 else None) for arm, k in (("A", 1), ("B", 2)) for i in range(20)] + [("A", "only", True, None, None)]
    j = spark.createDataFrame(rows, "arm string, id string, is_correct boolean, score double, category string")
    shared = evaluate.aligned(j)
    assert shared.count() == 40
    assert {(r.arm, r.category): r.n for r in evaluate.accuracy(shared).collect()} == {("A", "x"): 10, ("A", "all"): 10, ("B", "x"): 10, ("B", "all"): 10}
    (p,) = evaluate.paired(shared, "A", "B", rounds=200).collect()
    assert p.wins + p.losses + p.ties == 20 and p.low <= p.mean_diff <= p.high
    assert evaluate.mcnemar(0, 0) == 1.0 and evaluate.mcnemar(0, 5) == 2 / 32
