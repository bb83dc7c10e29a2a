"""Cell parsers: text in, typed value or null out. A null for a non-null cell is a violation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.text import strip


def parse_date(text: Column, formats=fv.DATE_FORMATS) -> Column:
    cell = strip(text)
    return F.coalesce(*[F.try_to_date(cell, fmt) for fmt in formats])


def parse_timestamp(text: Column, formats=fv.TIMESTAMP_FORMATS) -> Column:
    """To the second; finer digits are cut."""
    cell = strip(text)
    parsed = F.coalesce(*[F.try_to_timestamp(cell, F.lit(fmt)) for fmt in formats])
    return F.date_trunc("second", parsed).cast("timestamp_ntz")


def parse_money(text: Column, dtype: str = "decimal(14,2)") -> Column:
    return strip(text).try_cast(dtype)


def parse_bool(text: Column, true_words=fv.TRUE_WORDS) -> Column:
    """Null is false, a number is true unless zero, a word is true if listed."""
    number = strip(text).try_cast("double")
    word = F.upper(strip(text)).isin(*true_words)
    return F.when(text.isNull() | F.isnan(number), F.lit(False)).otherwise(
        F.coalesce(number != 0, word))
