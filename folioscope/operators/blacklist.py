"""Joins against the public blacklist, and browsing of it.

No join here carries a broadcast hint: the list grows with the authority's
publications, so whether it is small enough is left to its measured size
(autoBroadcastJoinThreshold at plan time, shuffle statistics at run time).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv


def status_lookup(rfcs: DataFrame, blacklist: DataFrame, key: str = "rfc") -> DataFrame:
    """L1. Adds the list status of `key`; the defaults stand for an unlisted ID."""
    listed = blacklist.select(
        F.col("rfc").alias(key), F.lit(True).alias("_listed"), "situacion", "publicacion_dof",
        "monto_presunto_total")
    return (rfcs.join(listed, key, "left")
            .withColumn("en_lista_69b", F.coalesce("_listed", F.lit(False)))
            .withColumn("monto_presunto_total",
                        F.coalesce("monto_presunto_total", F.lit(0).cast("decimal(14,2)")))
            .drop("_listed"))


def finally_listed(blacklist: DataFrame) -> DataFrame:
    return blacklist.where(F.col("situacion") == fv.STATUS_FINAL).select("rfc")


def listed_as_final(rfcs: DataFrame, blacklist: DataFrame) -> DataFrame:
    """L2. The subset of IDs with status DEFINITIVO."""
    return rfcs.join(finally_listed(blacklist), "rfc", "left_semi")


def counts_by_status(blacklist: DataFrame) -> DataFrame:
    """C1. Rows per status and, under status TOTAL, all of them."""
    return (blacklist.rollup("situacion").agg(F.count("*").alias("n"))
            .select(F.coalesce("situacion", F.lit("TOTAL")).alias("situacion"), "n"))


def search(blacklist: DataFrame, pattern: str = "",
           statuses: tuple = (fv.STATUS_FINAL,)) -> DataFrame:
    """C2. Every match of a pattern within the given statuses (none given means all)."""
    found = blacklist
    if statuses:
        found = found.where(F.col("situacion").isin(*statuses))
    if pattern.strip():
        found = found.where(F.col("rfc").rlike(pattern.strip().upper()))
    return found.select("rfc", "situacion", "publicacion_dof", "monto_presunto_total")


def search_page(blacklist: DataFrame, pattern: str = "",
                statuses: tuple = (fv.STATUS_FINAL,), size: int = 500) -> DataFrame:
    """C2. The page shown: newest first; `search(...).count()` is the full count."""
    return search(blacklist, pattern, statuses).orderBy(
        F.desc("publicacion_dof"), "rfc").limit(size)
