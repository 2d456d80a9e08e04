import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(n: int, seed: int, vocabulary: int = 3000) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs_frame(spark, rows, extra: bool = True):
    """rows: (doc_id, text[, source]); extra columns have names that operators use inside."""
    data = [(r[0], r[1], r[2] if len(r) > 2 else "a", 1, 2, 3, "x") for r in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, block long, rep long, start long, `odd name` string")
    return df if extra else df.select("doc_id", "text", "source")


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
