"""T1-T3. Thresholds relative to the amounts that really move in the ledger."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import settle
from folioscope.settings import Settings

_BUCKETS = 20_000


def _rank(fraction: float, n: int) -> int:
    """0-based position of the percentile, without interpolation."""
    return min(int(fraction * n), n - 1)


def exact_percentiles(amounts: DataFrame, column: str, fractions) -> list[Decimal | None]:
    """Elements at the given rank fractions of the sorted non-null amounts.

    The amounts are reduced to a table of (cents, count), which map-side
    combination keeps small, and the rank is then narrowed down by bucket counts:
    each round returns at most 20,000 counts per fraction to the driver and
    divides the value range by 20,000. No sort, and no task ever holds all
    distinct values. Three rounds cover the whole decimal(14,2) range.
    """
    tally = settle(
        amounts.where(F.col(column).isNotNull())
        .select((F.col(column) * 100).cast("long").alias("cents"))
        .groupBy("cents").agg(F.count("*").alias("n")))
    total, low, high = tally.agg(F.sum("n"), F.min("cents"), F.max("cents")).first()
    if not total:
        return [None for _ in fractions]

    # Per fraction: value range that still holds the rank, and the rank within it.
    open_ranges = {i: (low, high, _rank(f, total)) for i, f in enumerate(fractions)}
    found: dict[int, int] = {}
    while open_ranges:
        counts: dict[int, list] = {}
        rounds, widths = [], {}
        for i, (lo, hi, _) in open_ranges.items():
            widths[i] = -(-(hi - lo + 1) // _BUCKETS)
            rounds.append(
                tally.where(F.col("cents").between(lo, hi))
                .groupBy(F.lit(i).alias("i"),
                         F.floor((F.col("cents") - lo) / widths[i]).cast("long").alias("bucket"))
                .agg(F.sum("n").alias("n")))
        merged = rounds[0]
        for other in rounds[1:]:
            merged = merged.union(other)
        for i, bucket, n in merged.collect():
            counts.setdefault(i, []).append((bucket, n))
        for i, (lo, hi, rank) in list(open_ranges.items()):
            for bucket, n in sorted(counts[i]):
                if rank < n:
                    start = lo + bucket * widths[i]
                    open_ranges[i] = (start, min(hi, start + widths[i] - 1), rank)
                    break
                rank -= n
            if widths[i] == 1:
                found[i] = open_ranges.pop(i)[0]
    return [Decimal(found[i]).scaleb(-2) for i in range(len(fractions))]


def relative_threshold(value: Decimal | None, floor: float) -> Decimal:
    floor = Decimal(str(floor))
    return floor if value is None else max(value, floor)


def amount_thresholds(ledger: DataFrame, settings: Settings = Settings()) -> tuple:
    """(cycle threshold, undeclared-income threshold), from one pass over the ledger.

    The second is shared by the detector and the proof, so they can not disagree.
    """
    cycle, income = exact_percentiles(
        ledger, "monto", (settings.cycle_percentile, settings.income_percentile))
    return (relative_threshold(cycle, settings.cycle_floor),
            relative_threshold(income, settings.income_floor))
