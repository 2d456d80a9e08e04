import hashlib
import random

from memloom.llm import substring_dedup

from .helpers import WORDS, docs_frame, words


def brute(rows):
    first, out = {}, {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                x = tuple(w[k : k + 13])
                first[x] = min(first.get(x, i), i)
    for i, w in split:
        gone = {p for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.setdefault(i, []).append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


def test_equals_brute_force(spark):
    r = random.Random(4)
    passage, long = words(70, 1), words(15, 2)
    rows = []
    for i in range(120):
        w = words(r.randrange(0, 90), 100 + i)
        for part in (passage, long, ["a"] * 30):
            if r.random() < 0.5:
                cut = part[r.randrange(3) : len(part) - r.randrange(3)]
                at = r.randrange(len(w) + 1)
                w = w[:at] + cut + w[at:]
        rows.append((i, " \n".join(w)))
    rows += [(200 + i, rows[5][1]) for i in range(30)]
    rows += [(300 + i, " ".join([*passage[:30], f"edit{i}", *passage[31:]])) for i in range(20)]  # one anchor, several segments
    rows += [(400, None), (401, ""), (402, "\t"), (403, "Ünïcode " * 40), (404, "Ünïcode " * 20), (405, " ".join(passage) * 3), (None, " ".join(passage)), (406, "x" * 100_000), (5, rows[5][1])]
    got = {}
    for x in substring_dedup.summary(substring_dedup.deduplicate(docs_frame(spark, rows))).collect():
        got.setdefault(x.doc_id, []).append((x.n_words, x.n_removed, x.kept_sha256))
    want = brute(rows)
    assert got.keys() == want.keys()
    for i in want:
        assert sorted(got[i]) == sorted(want[i]), i
    assert substring_dedup.deduplicate(docs_frame(spark, rows).limit(0)).collect() == []
