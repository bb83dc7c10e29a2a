"""Tax ID expressions: check character, tri-state validity, bounded edit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.text import strip


def clean_taxid(rfc: Column) -> Column:
    return F.upper(strip(rfc))


def check_character(rfc: Column) -> Column:
    """Character the ID should end with; null when the ID cannot be evaluated.

    Twelve weighted positions summed modulo 11. A company ID has 12 characters
    and is evaluated with a blank in front.
    """
    clean = clean_taxid(rfc)
    padded = F.when(F.length(clean) == 12, F.concat(F.lit(" "), clean)).when(
        F.length(clean) == 13, clean)
    body = F.substring(padded, 1, 12)
    total = F.lit(0)
    for position in range(1, 13):
        value = F.instr(F.lit(fv.TAXID_ALPHABET), F.substring(body, position, 1)) - 1
        total = total + value * (14 - position)
    remainder = total % fv.TAXID_MODULUS
    expected = (F.when(remainder == 0, F.lit("0"))
                .when(remainder == 1, F.lit("A"))
                .otherwise((F.lit(fv.TAXID_MODULUS) - remainder).cast("string")))
    return F.when(body.rlike("^[" + fv.TAXID_ALPHABET + "]{12}$"), expected)


def is_valid_taxid(rfc: Column) -> Column:
    """True or false by the check character, null when not evaluable."""
    return F.right(clean_taxid(rfc), F.lit(1)) == check_character(rfc)


def bounded_distance(left: Column, right: Column, cap: int) -> Column:
    """Edit distance, or cap + 1 for anything further apart."""
    distance = F.levenshtein(left, right, cap)
    return F.when(distance < 0, F.lit(cap + 1)).otherwise(distance)


def deletion_keys(rfc: Column, edits: int) -> Column:
    """Hashes of every string left after deleting up to `edits` characters.

    Two strings within `edits` edits of each other always share one of these, so
    they make an exact equi-join key for a similarity join. Unlike a shared
    segment, a key is only shared by strings that are nearly equal: a prefix or a
    date that a third of all IDs have does not make a hot group.
    """
    def without_one(text):
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
            lambda i: F.concat(F.substring(text, F.lit(1), i - 1),
                               F.substring(text, i + 1, F.length(text))))

    layer = F.array(rfc)
    variants = layer
    for _ in range(edits):
        layer = F.array_distinct(F.flatten(F.transform(layer, without_one)))
        variants = F.array_union(variants, layer)
    return F.transform(variants, lambda v: F.xxhash64(v))
