import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memloom.llm import packing

from .helpers import docs_frame, words


@pytest.fixture(scope="module")
def full():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = [
    "", "plain words, and 123 numbers!", "Ça va très bien — naïve façade", "<|endoftext|> as text", "tabs\tand\r\nlines\n\n  ", "漢字かな交じり文 🎉🎉", "a b\u0085c d", "it's we'll they'VE", "x" * 5000, " ".join(words(2500, 1)), "ǅ ʹ Ωmega", "\x1c\x1d control \x00",
]


def test_both_encoders_give_the_same_ids(full):
    encode = packing.byte_bpe()
    for t in TEXTS:
        assert encode(t) == full(t), t[:30]


def test_every_id_lies_in_one_piece_and_nothing_is_padded(spark, full):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "no id"), (3, TEXTS[3])] + [(100 + i, " ".join(words(i * 7 % 400, i))) for i in range(120)]
    got = packing.pack(docs_frame(spark, rows)).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(full(t or "") + [0])
    seen, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: sum(map(len, x)) for i, x in ids.items()}
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total <= 1024 and total & (total - 1) == 0
    short = [s for s in sequences.values() if sum(n for _, n in s) < 1024]
    assert len(short) <= 55 * 4  # a worker leaves fewer than k pieces of class k open, closed as runs of a power of two
    assert packing.pack(docs_frame(spark, rows).limit(0)).collect() == []


def test_pieces_hold_their_ids(spark, full, monkeypatch):
    monkeypatch.setattr(packing, "IDS_OUT", 2000)  # so that there are many batches
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None)]
    got = packing.pack(docs_frame(spark, rows)).orderBy("doc_id", "start").collect()
    ids = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        ids[r.doc_id] += r.ids
    assert ids == {i: full(t or "") + [0] for i, t in rows}
    assert "ids" not in packing.summary(packing.pack(docs_frame(spark, rows))).columns


def test_cut_and_classes():
    for n in (1, 2, 1023, 1024, 1025, 3000):
        pieces = list(packing.cut(n, 1024))
        assert sum(p for _, p in pieces) == n and [s for s, _ in pieces] == [sum(p for _, p in pieces[:i]) for i in range(len(pieces))]
    with pytest.raises(ValueError):
        packing.HarmonicBins(1000, 0)


def test_special_strings_have_the_ids_of_the_plain_call(full):
    assert packing.byte_bpe()("a <|endoftext|> b") == full("a <|endoftext|> b")


def test_a_bin_of_class_k_holds_k_remainders_and_few_pieces_a_document(monkeypatch):
    capacity, r = 64, np.random.default_rng(5)
    bins = packing.HarmonicBins(capacity, 7)
    sizes = [int(x) for x in r.integers(1, 200, 3000)] + [1] * 70 + [64, 128, 63]
    out = [x for i, n in enumerate(sizes) for x in bins.take((i, n), np.arange(n, dtype="<u4"))]
    assert sum(map(len, bins.open.values())) + sum(map(len, bins.waiting)) < capacity * 3
    full = len(out)
    out += bins.rest()
    sequences = defaultdict(list)
    for piece, sequence, offset in out:
        sequences[sequence].append((offset, *piece))
    assert min(sequences) == 7 and len(sequences) == max(sequences) - 6
    seen = defaultdict(list)
    for at, pieces in sequences.items():
        assert [p[0] for p in pieces] == [sum(len(q[3]) for q in pieces[:i]) for i in range(len(pieces))]
        total = sum(len(p[3]) for p in pieces)
        assert total == capacity or total & (total - 1) == 0
        for _, doc, start, ids in pieces:
            seen[doc[0]] += ids.tolist()
            assert ids[0] == start
    assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(sizes))
    for at in {s for _, s, _ in out[:full]}:  # the first k pieces are of class k, the rest tops up
        k = capacity // len(sequences[at][0][3])
        assert all(capacity // len(p[3]) == k for p in sequences[at][:k])
        assert sum(len(p[3]) for p in sequences[at][k:]) < capacity / (k + 1)
    assert len(out) < sum(-(-n // capacity) for n in sizes) + 0.6 * len(sizes)
