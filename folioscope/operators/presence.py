"""Keep the records that may hold one of a set of keys, without moving the records.

The keys are drawn as bits on a map of 2^27 places, 16 MiB at most however many keys there
are, so the map can be broadcast and the records are tested where they are read. No record
with a key is lost; of the others a share of about keys / 2^27 stays, and whatever passes
is looked up exactly by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLACES = 1 << 27
_WORDS = 512        # of a row of the map


def _place(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(_PLACES)) + 1


def key_map(keys: DataFrame, *columns: Column) -> DataFrame:
    """(_bucket, _words): the map of the keys, at most 4,096 rows of 4 KiB.

    The bits are kept as whole numbers: a record then looks at one of them, where of binary it
    would copy the row's 4 KiB.
    """
    drawn = keys.select(_place(list(columns)).alias("_place"))
    bits = drawn.groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    # The array of one names the bits, so they are copied once and not for every number.
    return bits.select("_bucket", F.flatten(F.transform(
        F.array("_bits"), lambda row: F.transform(
            F.sequence(F.lit(0), F.lit(_WORDS - 1)),
            lambda i: F.conv(F.hex(F.substring(row, i * 8 + 1, F.lit(8))), 16, -10)
            .cast("long")))).alias("_words"))


def among(records: DataFrame, drawn: DataFrame, name: str, *columns: Column) -> DataFrame:
    """The records with a column `name`: whether their columns may equal a key of `drawn`.

    The columns must have the types the keys had. Broadcasting is safe: the map is bounded.
    """
    place = _place(list(columns))
    placed = records.withColumns({"_bucket": F.bitmap_bucket_number(place),
                                  "_bit": F.bitmap_bit_position(place)})
    inside = F.pmod("_bit", F.lit(64)).cast("int")      # the first of a word's bytes is its highest
    word = F.get("_words", F.call_function("shiftright", F.col("_bit"), F.lit(6)).cast("int"))
    bit = F.call_function("shiftright", word, inside.bitwiseXOR(F.lit(56)))
    return (placed.join(F.broadcast(drawn), "_bucket", "left")
            .select(*records.columns,
                    F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False)).alias(name)))


def maybe_among(records: DataFrame, drawn: DataFrame, *columns: Column) -> DataFrame:
    """The records whose columns may equal a key that `drawn` was made of."""
    return among(records, drawn, "_may", *columns).where("_may").select(*records.columns)
