"""Consecutive numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import settle


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Add `name`, the 1-based place of each row in the given order.

    The rows are range-partitioned and settled, so that the partition sizes and the
    rows come from the same cut; each task numbers its own range and adds the size
    of the ranges before it (one row per partition).
    """
    ranges = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (ranges.withColumn("_in", F.row_number().over(inside))
            .join(offsets, "_part")
            .withColumn(name, (F.col("_in") + F.col("_off")).cast("long"))
            .drop("_part", "_in", "_off"))
