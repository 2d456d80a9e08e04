import random

from pyspark.sql import functions as F

from memloom.llm import warc_revisit


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, at long, kind string, etag string, last_modified string, headers map<string,string>, digest string, slice string")


def test_canonical_urls(spark):
    urls = {
        "HTTP://www.Ex.com:80/a/?utm_source=x&b=2&a=1#f": "ex.com/a?a=1&b=2", "https://ex.com": "ex.com/", "https://ex.com/?ref=q": "ex.com/", "no url": None, "https://m.ex.com/A.html": "m.ex.com/A.html", "https://ex.com?x=1": "ex.com/?x=1",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc_revisit.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == urls


def test_as_of_join_equals_brute_force_over_time_slices(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        kind = "response" if r.random() < 0.4 else "revisit"
        rows.append((i, f"https://h.com/{0 if r.random() < 0.5 else r.randrange(4)}", r.randrange(60), kind, r.choice(["a", "W/a", "b", None]), r.choice(["m", "n", None]), {"Date": str(i), "Set-Cookie": "c", "X": kind}, f"d{i}" if kind == "response" else None))
    rows += [(1000, None, 5, "revisit", "a", None, None, None), (1001, "https://h.com/0", None, "revisit", "a", None, None, None), (None, "https://h.com/9", 1, "odd", None, None, None, None)]
    got = {x.record_id: x for x in warc_revisit.resolve(frame(spark, rows), slice_rows=20).collect()}
    assert len(got) == len(rows)
    for i, url, at, kind, etag, mod, headers, digest in rows[:300]:
        if kind == "response":
            assert got[i].status == "response" and got[i].digest == digest
            continue
        earlier = [x for x in rows[:300] if x[3] == "response" and x[1] == url and (x[2], x[0]) < (at, i)]
        if not earlier:
            assert got[i].status == "orphan" and got[i].digest is None
            continue
        best = max(earlier, key=lambda x: (x[2], x[0]))
        strong = lambda t: t and t.removeprefix("W/")
        same = strong(etag) == strong(best[4]) if etag and best[4] else mod == best[5] if mod and best[5] else None
        want = {True: "resolved", False: "mismatch", None: "unverified"}[same]
        assert got[i].status == want
        if want != "mismatch":
            assert got[i].refers_to == best[0] and got[i].digest == best[7]
            assert got[i].headers == {"date": str(i), "set-cookie": "c", "x": "response"}
    assert {got[1000].status, got[1001].status, got[None].status} == {"orphan"}
    assert warc_revisit.resolve(frame(spark, rows).limit(0)).collect() == []
