"""What several operators of this folder use: settings, reading, keys and packing of texts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import tune

CONF = {
    # A batch handed to Python holds some megabytes of text, however long the texts are.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Shuffle files go when the write that needed them has ended.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on; partition counts stay the cluster's.

    Python workers look for this package where the driver has it; where executors have
    no such folder, submit the package with --py-files.
    """
    tune(spark)
    spark.sparkContext.environment.setdefault("PYTHONPATH",
                                              str(Path(__file__).resolve().parents[2]))
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(text: Column) -> Column:
    """With the ID, this tells rows apart; rows equal in both have equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and text: the three columns the text operators work on."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_key(F.col(text_col)).alias("text_key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def str_texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def chunks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list of sizes into runs of about `limit` in total."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; the number of buckets follows from it."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def bucket_count(units: float, per_bucket: float) -> int:
    return max(1, math.ceil(units / per_bucket))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most `rows` labelled documents, the ones with the smallest hash of their ID.

    The bound makes the broadcast side small at any size of the corpus. A label row
    without an ID or a 0/1 label is left out; of several rows of an ID the smaller
    label counts, so repeated rows do not matter. Of several documents of an ID, one
    stands for all, chosen by the hash of its text.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("quality").cast("int").alias("label"))
              .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
              .groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64(F.col("doc_id"), F.lit(salt)), "doc_id").limit(rows))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(
        F.min("label").alias("label"),
        F.min(F.struct(text_key(F.col("text")).alias("key"), "text")).alias("one")).select(
        "doc_id", F.col("one.text").alias("text"), "label")
