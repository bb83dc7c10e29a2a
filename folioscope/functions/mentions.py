"""Every place where a tax ID occurs in a text, with the text around it.

The text is cut in front of each ID in one pass, so the work grows with the
length of the text and not with the number of known IDs, and no text is copied
once per ID. All of it is built-in expressions.

IDs of any other shape are found as literals (`literal_mentions`): each is known by
the one of its short substrings that is rarest in the texts, the texts are asked for those
substrings by equality, and what stands around one is looked up among the whole IDs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.operators.presence import key_map, maybe_among
from folioscope.session import settle

# IDs overlap at most in pairs (3 or 4 letters in front of the same digits) and
# digit runs start at least 9 characters apart, so 48 pieces always span more
# than the widest window (180) plus the ID itself.
_PIECES_PER_WINDOW = 48
_LONGEST_ID = 13
_GRAM = 4                # length of the substrings that literals are known by
_PIECE = 4096            # characters of a piece of text that is searched at once
_START = "\u0001"
_IN_FRONT_OF_ID = "(?i)(?=" + fv.TAXID_SHAPE.replace("Ñ", "Ññ") + ")"


def strict_taxids(text: Column) -> Column:
    """Upper-case IDs that stand as a word of their own."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fv.TAXID_PATTERN), F.lit(0)))


def folio_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fv.UUID_PATTERN), F.lit(0)))


def identifiers(text: Column) -> Column:
    """Folios and tax IDs a text cites."""
    return F.array_union(folio_ids(text), strict_taxids(text))


def taxid_mentions(texts: DataFrame, text_id: str, text: str, window: int) -> DataFrame:
    """(text_id, ordinal, rfc, before, after): one row per occurrence, any letter case.

    `rfc` keeps the letter case of the text. An occurrence of 13 characters also
    contains one of 12; both are returned, at their own ordinal.
    """
    pieces = F.split(F.concat(F.lit(_START), F.col(text)), _IN_FRONT_OF_ID, -1)
    cut = texts.select(F.col(text_id), pieces.alias("_pieces")).where(F.size("_pieces") > 1)
    rows = cut.select(
        text_id, "_pieces",
        F.explode(F.sequence(F.lit(2), F.size("_pieces"))).alias("ordinal"))
    near_before = F.slice(
        "_pieces", F.greatest(F.lit(1), F.col("ordinal") - _PIECES_PER_WINDOW),
        F.least(F.col("ordinal") - 1, F.lit(_PIECES_PER_WINDOW)))
    near_after = F.slice("_pieces", F.col("ordinal"), F.lit(_PIECES_PER_WINDOW))
    reach = window + _LONGEST_ID
    rows = rows.select(
        text_id, "ordinal",
        F.replace(F.right(F.array_join(F.transform(
            near_before, lambda p: F.right(p, F.lit(window))), ""), F.lit(window)),
            F.lit(_START), F.lit("")).alias("before"),
        F.left(F.array_join(F.transform(
            near_after, lambda p: F.left(p, F.lit(reach))), ""), F.lit(reach)).alias("ahead"))
    shape = "(?i)^" + fv.TAXID_SHAPE.replace("Ñ", "Ññ") + "$"
    sized = rows.select(
        "*", F.explode(F.array(F.lit(12), F.lit(13))).alias("_size")
    ).withColumn("rfc", F.left("ahead", "_size")).where(F.col("rfc").rlike(shape))
    return sized.select(
        text_id, "ordinal", "rfc", "before",
        F.substring(F.col("ahead"), F.col("_size") + 1, F.lit(window)).alias("after"))


def _grams(chars: Column, size: int) -> Column:
    """All substrings of `size` characters, from an array of characters."""
    whole = F.size(chars) >= size
    return F.when(whole, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(chars) - size, F.lit(0))),
        lambda i: F.concat(*(F.get(chars, i + k) for k in range(size)))))).otherwise(
            F.array().cast("array<string>"))


def _all_grams(text: Column, sizes: list[int]) -> Column:
    return F.flatten(F.transform(F.array(F.split(text, "", -1)), lambda chars: F.flatten(
        F.array(*(_grams(chars, size) for size in sizes)))))


def text_pieces(texts: DataFrame, text_id: str, text: str, reach: int) -> DataFrame:
    """(text_id, piece, before, body, after): texts in pieces, with `reach` characters around."""
    size = max(_PIECE, reach)
    cut = texts.select(text_id, F.regexp_extract_all(
        F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_all"))
    return cut.select(text_id, "_all", F.posexplode("_all").alias("piece", "body")).select(
        text_id, "piece",
        F.right(F.coalesce(F.get("_all", F.col("piece") - 1), F.lit("")), F.lit(reach))
        .alias("before"), "body",
        F.left(F.coalesce(F.get("_all", F.col("piece") + 1), F.lit("")), F.lit(reach))
        .alias("after"))


def literal_mentions(texts: DataFrame, text_id: str, text: str, ids: DataFrame,
                     window: int) -> DataFrame:
    """(text_id, ordinal, rfc, before, after): each place where one of `ids.rfc` stands.

    IDs are any strings that are not empty, and places may overlap. text_id is unique. The
    join is by equality of substrings of up to four characters, each ID by its rarest one, so
    neither the number of IDs nor what many of them share multiplies the texts.
    """
    ids = ids.select("rfc").where("rfc <> ''").distinct()
    longest, sizes = ids.agg(F.max(F.length("rfc")), F.collect_set(
        F.least(F.length("rfc"), F.lit(_GRAM)))).first()
    if longest is None:
        nothing = F.lit(None).cast("string")
        return texts.select(text_id, F.lit(0).cast("long").alias("ordinal"), nothing.alias("rfc"),
                            nothing.alias("before"), nothing.alias("after")).limit(0)
    reach = window + longest
    pieces = settle(text_pieces(texts, text_id, text, reach))
    own = ids.select("rfc", F.explode(_all_grams(F.col("rfc"), sizes)).alias("gram")).where(
        F.length("gram") == F.least(F.length("rfc"), F.lit(_GRAM)))
    asked = pieces.select(text_id, "piece", F.explode(_all_grams(F.concat(
        "body", F.left("after", F.lit(longest))), sizes)).alias("gram"))
    held = settle(asked.join(own.select("gram").distinct(), "gram", "left_semi"))
    common = held.groupBy("gram").agg(F.count("*").alias("n"))
    # An ID with a substring that no text holds is in no text.
    known = own.join(common, "gram", "left").groupBy("rfc").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).select(
        "rfc", "rarest.gram", "rarest.n").where("n > 0").drop("n")
    known = settle(known.withColumn("skip", F.instr("rfc", F.col("gram")) - 1))
    # Where a substring stands, an ID can only begin so many characters before it and be so long.
    # What stands there is then the ID or not, so IDs that share a substring are never tried in turn.
    shapes = known.groupBy("gram").agg(F.collect_set(F.struct(
        "skip", F.length("rfc").alias("size"))).alias("shapes"))
    whole = F.concat("before", "body", "after")
    met = (held.join(shapes, "gram").groupBy(text_id, "piece").agg(
        F.collect_set(F.struct("gram", "shapes")).alias("_grams"))
           .join(pieces, [text_id, "piece"])
           .select(text_id, "piece", whole.alias("_whole"), F.length("before").alias("_from"),
                   F.length("body").alias("_length"), F.explode("_grams").alias("_g"))
           .select(text_id, "piece", "_whole", "_from", "_length", "_g.shapes",
                   F.explode(_starts(F.col("_whole"), F.col("_g.gram"))).alias("_gram_at"))
           .select("*", F.explode("shapes").alias("_shape"))
           .withColumn("_at", F.col("_gram_at") - F.col("_shape.skip"))
           .where((F.col("_at") > F.col("_from"))
                  & (F.col("_at") <= F.col("_from") + F.col("_length")))
           .withColumn("rfc", F.substring(F.col("_whole"), F.col("_at"), F.col("_shape.size")))
           .select(text_id, "piece", "_whole", "_from", "_at", "rfc",
                   (F.col("_at") - F.col("_gram_at")).alias("_back")))
    # An ID counts where its own substring found it, so each place comes out once.
    own_place = known.select("rfc", (-F.col("skip")).alias("_back"))
    pair = F.col("rfc"), F.col("_back")
    return maybe_among(met, key_map(own_place, *pair), *pair).select(
        text_id, (F.col("piece").cast("long") * max(_PIECE, reach) + F.col("_at")
                  - F.col("_from")).alias("ordinal"), "rfc", "_back",
        F.right(F.left("_whole", F.col("_at") - 1), F.lit(window)).alias("before"),
        F.substring(F.col("_whole"), F.col("_at") + F.length("rfc"), F.lit(window))
        .alias("after")).join(own_place, ["rfc", "_back"], "left_semi").select(
        text_id, "ordinal", "rfc", "before", "after")


def _starts(text: Column, part: Column) -> Column:
    """Every place, from one, where `part` starts in a text; places may overlap."""
    literal = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                       F.lit("\\E)"))
    parts = F.split(F.concat(F.lit(_START), text), literal, -1)
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda seen, p: F.concat(
        seen, F.array(F.coalesce(F.get(seen, F.size(seen) - 1), F.lit(0)) + F.length(p))))
    return F.slice(ends, F.lit(1), F.size(ends) - 1)      # in _START + text: from one
