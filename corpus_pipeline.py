"""A corpus pipeline: quality, near copies, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame. `run` writes each result as
Parquet to the shared folder and reads it back as the next one's docs, so a lost executor
costs a re-read. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import (near_copies, op1_decontamination, op6_packing, op9_quality,
                            op10_pii)
from folioscope.llm.shared import prepare, table
from folioscope.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    net = op9_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = op9_quality.scored(docs, net, *docs.columns, name="__score")
    return scored.filter("__score >= 0.3").drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word similarity of 0.8 or more, among what
    op4's fingerprints link and what min-hashes add."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those made of them go."""
    return op1_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and what gives it away."""
    return op10_pii.sanitise(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 1024 tokens."""
    return op6_packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("pii", pii), ("packing", packing)]

# Fingerprints, learned scores and token ids are beyond SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
