import math
import random
import re
import zlib

import numpy as np

from memloom.llm import toxicity

from .helpers import docs_frame, words


def corpus(n=600):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = words(40, i, 300) + (r.sample(["vilek", "grumpf", "zotter"], 2) if bad else []) + (["women"] if bad or i % 9 == 0 else [])
        r.shuffle(text)
        rows.append((i, " ".join(text).capitalize() + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows, labels = corpus()
    docs = docs_frame(spark, rows + [(9001, None), (9002, ""), (None, "vilek grumpf"), (0, rows[0][1])])
    lab = spark.createDataFrame([*labels, (9001, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    y = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert {r.doc_id for r in held} == {i for i in y if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns
    one = model.scorer()
    neutral, plain = one("the women met on monday"), one("the men met on monday")
    assert abs(neutral - plain) < 0.1 and neutral < 0.7


def test_swaps_are_penalised():
    x = [np.array(sorted(toxicity.features_of(w) | toxicity.features_of("word")), np.uint32) for w in ["women", "men"] * 40]
    y = np.array([1, 0] * 40)
    free, tied = toxicity.train(x, y, []), toxicity.train(x, y, [("women", "men", 500), ("men", "women", 500)])
    gap = lambda m: m.scorer()("word women") - m.scorer()("word men")
    assert gap(tied) < gap(free) / 3


def test_without_usable_labels(spark):
    docs = docs_frame(spark, [(1, "a"), (2, None)])
    lab = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, lab)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), lab.limit(0))).collect() == []


def test_fit_and_score_equal_a_plain_second_version(spark):
    rows, labels = corpus(240)
    rows = [(i, t + " Men came." * (i % 3)) for i, t in rows] + [(7000, "long " * 30_000 + "vilek. women went")]
    labels += [(7000, 1)]
    model = toxicity.fit(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    learnt = [(dict(rows)[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]

    def parts(word):
        return {zlib.crc32(word.encode())} | {zlib.crc32((word[:n] + "*").encode()) for n in (4, 5) if len(word) >= n}

    def features(text):
        return {f for w in re.findall(r"[^\W\d_]+", text.lower()) for f in parts(w)}

    sets = [(features(t), y) for t, y in learnt]
    n, n_pos = len(sets), sum(y for _, y in sets)
    strengths = {}
    for f in set().union(*(s for s, _ in sets)):
        total, pos = sum(f in s for s, _ in sets), sum(f in s and y for s, y in sets)
        if 3 <= total < n:
            rate = total / n
            strengths[f] = abs(pos / n_pos - (total - pos) / (n - n_pos)) / math.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / (n - n_pos)))
    best = sorted((f for f in strengths if strengths[f] > 0), key=lambda f: (-strengths[f], f))[:512]
    assert set(model.weights) == set(best)
    swaps = []
    for t, _ in learnt:
        for sentence in re.split(r"[.!?\n]+", t.lower()):
            for w in {"women", "men"} & set(re.findall(r"[^\W\d_]+", sentence)):
                swaps += [(w, other) for other in "women men girls boys".split() if other != w]
    gradient = dict.fromkeys([*best, None], 0.0)  # of the penalised loss: nothing at its only minimum
    for s, y in sets:
        p = 1 / (1 + math.exp(-model.bias - sum(model.weights[f] for f in best if f in s)))
        weight = min(max((n - n_pos) / n_pos, 1), 8) if y else 1
        for f in [*(f for f in best if f in s), None]:
            gradient[f] += weight * (p - y)
    for f in best:
        gradient[f] += 0.1 * model.weights[f]
    for a, b in swaps:
        change = sum(model.weights.get(f, 0) for f in parts(b) - parts(a)) - sum(model.weights.get(f, 0) for f in parts(a) - parts(b))
        for f in parts(a) ^ parts(b):
            if f in gradient:
                gradient[f] += change if f in parts(b) else -change
    assert max(map(abs, gradient.values())) < 0.02
    got = {r.doc_id: r.score for r in toxicity.score(docs_frame(spark, rows), model).collect()}
    for i, t in rows:
        z = model.bias + sum(w for f, w in model.weights.items() if f in features(t))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-9


def test_fewer_false_positives_on_neutral_mentions():
    r = random.Random(3)
    groups = "muslims jews christians hindus".split()
    texts, labels = [], []
    for i in range(400):  # one group is mostly named in toxic texts
        bad = i % 2
        named = groups[0] if bad and i % 3 else r.choice(groups[1:]) if i % 3 else None
        texts.append([*words(12, i, 200), *(["vilek"] if bad and i % 5 else []), *([named] if named else [])])
        labels.append(bad)
    features = [np.array(sorted(set().union(*map(toxicity.features_of, t))), np.uint32) for t in texts]
    pairs = [(w, o, 1) for t in texts for w in t if w in groups for o in "christians muslims jews hindus buddhists atheists".split() if o != w]
    rates = []
    for swaps in ([], pairs):
        one = toxicity.train(features, np.array(labels), swaps).scorer()
        neutral = [one(" ".join([*words(12, 10_000 + i, 200), groups[0]])) for i in range(200)]
        toxic = [one(" ".join([*words(12, 20_000 + i, 200), "vilek"])) for i in range(200)]
        rates.append(np.mean([s >= 0.7 for s in neutral]))
        assert np.mean([s >= 0.5 for s in toxic]) > 0.8
    assert rates[0] > 0.5 and rates[1] < 0.1


def test_strength_of_columns_is_that_of_arrays(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from memloom.llm.toxicity import strength, strength_column

    rows = [(t, p) for t in range(0, 41) for p in range(0, min(t, 13) + 1)]
    df = spark.createDataFrame(rows, "total long, pos long")
    got = [r.z for r in df.select(strength_column(F.col("total"), F.col("pos"), 40, 13).alias("z")).collect()]
    total, pos = np.array(rows, np.float64).T
    assert got == strength(total, pos, 40, 13).tolist()
