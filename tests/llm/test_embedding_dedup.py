import numpy as np

from memloom.llm import embedding_dedup

from .helpers import components


def brute(rows):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = {i: 0 for i, _, _ in rows}, []
    for a in range(len(ok)):
        for b in range(len(ok)):
            (i, v, y), (j, w, z) = ok[a], ok[b]
            if a != b and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                n[i] += 1
                links.append((i, j))
    return n, components(list(n), links)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1) for i, v, y in rows], "vec_id long, embedding array<float>, label int, rep long")


def test_links_equal_brute_force_and_recall(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)  # so that lists are split
    r = np.random.default_rng(3)
    rows, base = [], r.normal(size=(60, 24))
    for i in range(400):
        v = base[i % 60] + (r.normal(size=24) * 0.05 if i >= 60 else 0)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 60 % 3)))
    rows += [(400 + i, rows[5][1], rows[5][2]) for i in range(50)]  # exact copies
    rows += [(500, None, 1), (501, [0.0] * 24, 1), (502, [float("nan")] * 24, 1), (503, rows[0][1], None), (504, [1.0, None] + [0.0] * 22, 1), (505, [1.0, 2.0], 1), (506, [1.0, 2.0], 1), (507, [], 1)]
    want_n, want_c = brute(rows)
    got = {x.vec_id: x for x in embedding_dedup.deduplicate(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    found, total = sum(x.n_links for x in got.values()), sum(want_n.values())
    assert found >= 0.99 * total and all(got[i].n_links <= want_n[i] for i in want_n)
    assert sum(got[i].component_id == want_c[i] for i in want_c) >= 0.99 * len(rows)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_recall_with_a_third_of_the_rows_in_one_group_of_near_copies(spark):
    r = np.random.default_rng(1)
    n, group, dim = 6000, 2000, 16
    v = r.normal(size=(n, dim))
    v[:group] = v[0] / np.linalg.norm(v[0]) + r.normal(size=(group, dim)) * np.sqrt((1 / 0.985 - 1) / dim)
    v = v[r.permutation(n)].astype(np.float32)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    got = {x.vec_id: x.n_links for x in embedding_dedup.deduplicate(frame(spark, [(i, x.tolist(), 1) for i, x in enumerate(v)])).collect()}
    assert want.sum() > 0.5 * group**2
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)


def test_empty(spark):
    assert embedding_dedup.deduplicate(frame(spark, [(1, [1.0], 1)]).limit(0)).collect() == []
    assert [tuple(r) for r in embedding_dedup.deduplicate(frame(spark, [(1, None, 1), (2, None, None)])).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_every_vector_length_is_indexed(spark):
    r = np.random.default_rng(8)
    rows = []
    for dim in range(1, 100):
        base = r.normal(size=(3, dim))
        rows += [(1000 * dim + i, [float(np.float32(x)) for x in base[i % 3] + r.normal(size=dim) * 0.03], 1) for i in range(3 if dim % 2 else 9)]
    want_n, want_c = brute(rows)
    got = {x.vec_id: x for x in embedding_dedup.deduplicate(frame(spark, rows)).collect()}
    rare = [i for i in want_n if (i // 1000) % 2]  # lengths with few vectors, most of them not among the commonest
    for ids in (list(want_n), rare):
        assert sum(got[i].n_links for i in ids) >= 0.98 * sum(want_n[i] for i in ids)
    assert all(got[i].n_links <= want_n[i] for i in want_n)
