"""Text expressions: accent folding, header names, money, bounded windows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks that hold the accented Latin letters (Latin-1 to Latin Extended-B,
# Latin Extended Additional, the ligatures).
_LATIN_BLOCKS = ((0x80, 0x250), (0x1E00, 0x1F00), (0xFB00, 0xFB07))


def _folded(char: str) -> str:
    parts = unicodedata.normalize("NFKD", char)
    return "".join(c for c in parts if not unicodedata.combining(c))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Derive the folding tables from the Unicode data, one letter at a time."""
    single_from, single_to, longer = [], [], {}
    for start, stop in _LATIN_BLOCKS:
        for code in range(start, stop):
            char = chr(code).lower()
            folded = _folded(char)
            if len(char) != 1 or folded == char or char in longer or char in single_from:
                continue
            if len(folded) == 1:
                single_from.append(char)
                single_to.append(folded)
            else:
                longer[char] = folded
    return "".join(single_from), "".join(single_to), longer


_FROM, _TO, _LONGER = _fold_tables()
_LONGER_CLASS = "[" + "".join(_LONGER) + "]"


def fold(text: Column) -> Column:
    """Lower case without accents (compatibility forms unfolded, combining marks dropped)."""
    simple = F.translate(F.lower(text), _FROM, _TO)
    expanded = simple
    for char, replacement in _LONGER.items():
        expanded = F.replace(expanded, F.lit(char), F.lit(replacement))
    whole = F.when(simple.rlike(_LONGER_CLASS), expanded).otherwise(simple)
    plain = F.octet_length(text) == F.char_length(text)  # ASCII only
    return F.when(plain, F.lower(text)).otherwise(F.regexp_replace(whole, r"\p{M}", ""))


def header_name(text: Column) -> Column:
    """Comparable form of a header held as data: folded, letters and digits only."""
    return F.regexp_replace(fold(text), r"[^\p{L}\p{Nd}]", "")


def plain_header(name: str) -> str:
    """The same form for a name the driver holds (schema metadata)."""
    return "".join(c for c in _folded(str(name).lower()) if c.isalnum())


_WHITE_SPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount.cast("decimal(38,2)"), 2))


def quoted(text: Column) -> Column:
    """Escape the double quotes that delimit a label."""
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def contains_any(text: Column, terms) -> Column:
    """True when any literal term occurs in the text."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found
