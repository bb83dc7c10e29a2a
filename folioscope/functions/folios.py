"""Folios as short keys: what is shuffled by identifier is mostly the identifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z"
_UPPER = _LOWER.replace("a-f", "A-F")
_UPPER_MARK, _OTHER_MARK = b"\x01", b"\x00" * 18
_GROUPS, _DASHED = "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"


def dashed(digits: Column) -> Column:
    """32 hexadecimal digits as a UUID is written; the digits are named and worked out once."""
    return F.regexp_replace(digits, _GROUPS, _DASHED)


def packed(folio: Column) -> Column:
    """A key that is equal exactly where the folio is: 16 bytes for a UUID in lower case, 17 for
    one in upper case, and for any other text its bytes with 18 more. Null stays null.

    The planner must see that a key is only null where the folio is: it tests the keys of a join
    for null below everything else, and would work out key and folio once more to do so.
    """
    digits = F.coalesce(F.unhex(F.replace(folio, F.lit("-"), F.lit(""))), F.lit(b""))
    return (F.when(folio.rlike(_LOWER), digits)
            .when(folio.rlike(_UPPER), F.concat(digits, F.lit(_UPPER_MARK)))
            .otherwise(F.concat(folio.cast("binary"), F.lit(_OTHER_MARK))))


def unpacked(key: Column) -> Column:
    """The folio of a key."""
    upper = dashed(F.hex(F.substring(key, 1, 16)))
    size = F.octet_length(key)
    return (F.when(size == 16, F.lower(upper)).when(size == 17, upper)
            .otherwise(F.substring(key, F.lit(1), size - 18).cast("string")))
