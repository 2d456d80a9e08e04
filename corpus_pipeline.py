"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import minhash_dedup, mixing, packing, secret_scan, toxicity
from memloom.llm.common import in_written_order
from memloom.stage import delete_on_exit, stage_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of those that came.

    Null and empty texts score by the bias alone; repeated rows and rows without an id are judged one by one; an empty
    table stays empty; columns stay.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: sets of five-word shingles of similarity 0.8 or more.

    Of rows of one doc_id one stays; empty and null texts and rows without an id stay; an empty table stays empty;
    columns stay.
    """
    return minhash_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks; every document stays, null and empty texts, repeats and rows without an id as they are."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix; a null source is a source of its own, repeats and rows without an id stay."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids, numbered in the order of the mix: the stage before writes it, and it is read back by part and row.

    A null or empty text is its end token alone; repeats are packed as often as they occur; an empty table gives no pieces.
    """
    return packing.pack(in_written_order(docs, ["doc_id", "text"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{stage_dir(spark)}/memloom/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        delete_on_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs
