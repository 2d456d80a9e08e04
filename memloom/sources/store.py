"""Tables of the store as Parquet folders: typed reads, snapshot writes, lookups; vectors and their cache; model connectors."""

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom import schemas


class Store:
    """Tables under one folder. Each version of a table is a folder of its own, and the newest is what is read.

    A write makes a whole new version and then its marker, so readers never see half of one. read_only refuses writes.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, name: str) -> list[tuple[int, int]]:
        """(version, part) of all finished folders: v3 is part 0 of version 3, v3.1 what was appended to it first."""
        p, fs = self._path(name)
        if not fs.exists(p):
            return []
        jvm = self.spark.sparkContext._jvm
        done = [s.getPath() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        numbers = (x.getName().removeprefix("v").partition(".") for x in done)
        return sorted((int(version), int(part or 0)) for version, _, part in numbers)

    def versions(self, name: str) -> list[int]:
        return sorted({version for version, _ in self._folders(name)})

    def read(self, name: str) -> DataFrame:
        """The newest version with its declared schema; an empty table if there is none."""
        folders = self._folders(name)
        if not folders:
            return self.spark.createDataFrame([], schemas.of(name))
        newest = [f"{self.root}/{name}/v{v}" + (f".{part}" if part else "") for v, part in folders if v == folders[-1][0]]
        return self.spark.read.schema(schemas.of(name)).parquet(*newest)

    def _save(self, name: str, df: DataFrame, folder: str, partition_by: Iterable[str] = ()) -> None:
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        df.select(*schemas.of(name).names).write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{folder}")

    def write(self, name: str, df: DataFrame, partition_by: Iterable[str] = ()) -> None:
        """A new version of a table. Its rows may come from older versions."""
        v = self.versions(name)
        self._save(name, df, f"v{(v[-1] if v else 0) + 1}", partition_by)

    def append(self, name: str, df: DataFrame) -> None:
        """More rows of the newest version, in a folder beside it: what is there isn't written again until `compact`."""
        folders = self._folders(name)
        self._save(name, df, f"v{folders[-1][0]}.{folders[-1][1] + 1}" if folders else "v1")

    def compact(self, name: str) -> None:
        """The newest version and all that was appended to it as one new version."""
        self.write(name, self.read(name))

    def wipe(self, name: str) -> None:
        """A new, empty version: derived tables can be built again."""
        self.write(name, self.spark.createDataFrame([], schemas.of(name)))


def messages_where(messages: DataFrame, user_id: str | None = None, session_id: str | None = None, first_seq: int | None = None, last_seq: int | None = None, request_id: str | None = None) -> DataFrame:
    """The raw scan: every given clause is a plain predicate that reaches the Parquet reader."""
    clauses = [("user_id", user_id), ("session_id", session_id), ("request_id", request_id)]
    for c, v in clauses:
        if v is not None:
            messages = messages.where(F.col(c) == v)
    if first_seq is not None:
        messages = messages.where(F.col("seq") >= first_seq)
    if last_seq is not None:
        messages = messages.where(F.col("seq") <= last_seq)
    return messages


def current_refs(refs: DataFrame, messages: DataFrame, namespace: str) -> DataFrame:
    """refs (namespace, record_id, user_id, session_id) that resolve to a message of that user and session."""
    own = messages.select("record_id", F.col("user_id").alias("u"), F.col("session_id").alias("s"), "fingerprint", "occurred_at")
    return refs.where(F.col("namespace") == namespace).join(own, "record_id").where("user_id = u AND session_id = s").drop("u", "s")


# ---------------------------------------------------------------- connectors


def with_model(df: DataFrame, prompt: str, answer: str, make: Callable[[], Callable[[list[str]], list[str]]], batch: int = 10) -> DataFrame:
    """df with the model's answer to the column `prompt`. make() builds a client on the executor: texts -> texts, `batch` at a time."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{answer}` string"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make()
        for b in batches:
            texts = b[prompt].tolist()
            yield b.assign(**{answer: [a for i in range(0, len(texts), batch) for a in complete(texts[i : i + batch])]})

    return df.mapInPandas(work, schema)


def embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int, batch: int = 10) -> DataFrame:
    """(key, vector) of texts (key, text); a vector of another length, or one that isn't finite or is zero, stops the job."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            rows = b["text"].tolist()
            got = [v for i in range(0, len(rows), batch) for v in client(rows[i : i + batch])]
            for v in got:
                if len(v) != dimension or not any(v) or any(x != x or abs(x) == float("inf") for x in v):
                    raise ValueError("the embedding provider returned an invalid vector")
            yield pd.DataFrame({"key": b["key"], "vector": [[float(x) for x in v] for v in got]})

    return texts.mapInPandas(work, "key string, vector array<float>")


def cache_key(model: str, dimension: int, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dimension)), text), 256)


def embed_cached(texts: DataFrame, cache: DataFrame, make, model: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(vectors, cache): texts (id, text) with their vectors; only texts that the cache (key, vector) lacks are embedded, each once."""
    from memloom.stage import materialize

    keyed = texts.withColumn("key", cache_key(model, dimension, F.col("text")))
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    new = materialize(embed(missing, make, dimension), "vectors")
    cache = cache.unionByName(new)
    return keyed.join(cache, "key").select("id", "vector"), cache


def upsert_vectors(index: DataFrame, new: DataFrame, target: str) -> DataFrame:
    """memory_vectors after new (scope_key, memory_id, vector): a deterministic point per target and memory; the new vector wins."""
    point = F.sha2(F.concat_ws("|", F.lit(target), "memory_id"), 256)
    rows = new.select(point.alias("point_id"), F.lit(target).alias("target"), "scope_key", "memory_id", "vector")
    return index.join(rows.select("point_id"), "point_id", "left_anti").unionByName(rows)


def check_index(index: DataFrame, target: str, dimension: int) -> None:
    """Raises if the target's vectors aren't of this dimension."""
    if index.where((F.col("target") == target) & (F.size("vector") != dimension)).limit(1).count():
        raise ValueError("the index was built with another geometry")
