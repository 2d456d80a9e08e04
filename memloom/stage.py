"""Stage tables: Parquet under the folder that the whole cluster shares, so no result hangs on one executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, in local mode alone, since executors elsewhere don't share it."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="memloom-")
    return _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back, which cuts its lineage; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


#: Bytes of a table for each core up to which a scan of too few files is dealt out.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is a small table in fewer files than there are cores, so one file's only task doesn't do all the work; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SPREAD_BYTES and 0 < len(df.inputFiles()) < cores else df
