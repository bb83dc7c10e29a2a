"""PII: fixed patterns, and terms that give away what the patterns protect.

What the patterns find are protected entities. Words beside one may reveal it as well as
its own text does, so the corpus is asked how strongly: with N documents, n(e) that hold
entity e, n(t) that hold term t and n(t,e) that hold both, the information that t gives about e is log2(n(t,e) N / (n(t) n(e))), at most log2(N / n(e)), the information of
e itself. A term that gives `disclosure` of it or more, and is with e in `support` documents
or more, is a span of kind `term` wherever it stands in a document that holds e. `sanitise` puts the kind's name for an
entity, `[term]` for a term, and nothing for one that gives `removal` or more.

Texts are read once: that pass gives the spans, the terms of every document, and for one
with an entity the places of its terms. All the rest are joins and sums of hashes. Entities
that stand in the same documents are counted as one class, and so are terms, so a page of
many addresses and many names is not multiplied out.

All of it is DataFrame functions. Positions follow from the lengths of matches and of the
text between them. The patterns are written so that a match never tries the same text
twice (possessive quantifiers, and starts only where a run can start); the comments say
why that changes no match.

Null and empty texts have no spans. Rows equal in ID and text count once in all four
numbers, so they support no term, and get the same spans. A null ID is kept. Other columns
are not read, and kept by `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import keyed, prepare, table
from folioscope.session import settle

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    # A run of characters before @ either matches from its start or not at all; only a
    # match that ends inside a run (\G) leaves the rest of it as a start.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
             r"(?:\.[A-Za-z0-9-]++)++",
    # Digits are followed by a dot or not, wherever in them one starts.
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Matches are maximal runs; those of 12 to 19 digits are asked for at once.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_MATCH = "struct<start:int,end:int,match:string>"
_BLOCK = 64                            # matches whose places are summed up in one array
# A run of letters and digits with a letter in it, of any length. One that touches what
# addresses are made of may be a part of one, so it is no term.
_TERM = r"(?<![\p{L}0-9])[0-9]*+\p{L}[\p{L}0-9]*+"
_WORD = rf"(?<![._%+@-]){_TERM}(?![\p{{L}}0-9_%+@-])(?!\.[\p{{L}}0-9])"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def located(text: Column, pattern: str) -> Column:
    """Matches in a text, with their places in code points."""
    # An array of one struct, so that the matches are searched for once and then read.
    parts = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                             F.split(text, pattern, -1).alias("between")))
    return F.get(F.transform(parts, _placed), 0)


def _placed(part: Column) -> Column:
    """The matches with their places: a running sum, in blocks that are joined at the end."""
    found, between, none = part["found"], part["between"], F.array().cast(f"array<{_MATCH}>")

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(found, i))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), F.get(found, i).alias("match")))).alias("out"))

    def block(state: Column, first: Column) -> Column:
        # Every step copies its state, so that of a block holds the block alone.
        inner = F.aggregate(
            F.sequence(first, F.least(first + (_BLOCK - 1), F.size(found) - 1)),
            F.struct(state["at"].alias("at"), none.alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda s: F.struct(
            s["at"].alias("at"), F.concat(state["blocks"], F.array(s["out"])).alias("blocks"))), 0)

    walked = F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1, F.lit(_BLOCK)),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_MATCH}>>").alias("blocks")),
        block, lambda s: F.flatten(s["blocks"]))
    return F.when(F.size(found) > 0, walked).otherwise(none)


def luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 0, digit).when(double > 9, double - 9).otherwise(double)
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0),
                        lambda s, i: s + worth(i))
    return total % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """What a match must fulfil beside its pattern."""
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return luhn(digits)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns: array<struct<start, kind, end, match>>, in order."""
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        found = located(text, pattern)
        if kind in NEEDS:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(
                F.array().cast(f"array<{_MATCH}>"))
        parts.append(_of_kind(found, k, kind))
    return F.array_sort(F.concat(*parts))


def _of_kind(found: Column, number: int, kind: str) -> Column:
    return F.transform(F.filter(found, lambda m: holds(kind, m["match"])), lambda m: F.struct(
        m["start"], F.lit(number).alias("kind"), m["end"], m["match"]))


def _count(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


_PLACES = "array<struct<start:int,end:int,term:bigint>>"


def analysed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, terms, places) of every row; a span also has its entity.

    terms are the hashes of all terms; places those of the terms of a row with spans.
    """
    text = F.col("text")
    spans = F.transform(base_spans(text), lambda s: F.struct(
        s["start"], s["kind"], s["end"],
        F.xxhash64(s["kind"], F.lower(s["match"])).alias("entity")))
    terms = F.array_distinct(F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), lambda w: F.xxhash64(w)))
    places = F.transform(located(text, _WORD), lambda w: F.struct(
        w["start"], w["end"], F.xxhash64(F.lower(w["match"])).alias("term")))
    return (keyed(docs).select("doc_id", "text_key", "text", spans.alias("spans"))
            .select("doc_id", "text_key", "spans", terms.alias("terms"),
                    F.when(F.size("spans") > 0, places).otherwise(F.array().cast(_PLACES))
                    .alias("places")))


ROW = ["__id", "__key"]


def _row_key(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))


def _classes(held: DataFrame, what: str, name: str, n: str) -> DataFrame:
    """(what, name, n): things that stand in the same n rows have the same class."""
    row = F.struct(*ROW)
    return held.groupBy(what).agg(
        F.count("*").alias(n), F.bit_xor(F.xxhash64(row)).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), row)).alias("y")).select(
        what, F.xxhash64(n, "x", "y").alias(name), n)


def _count_of_terms(found: DataFrame, times: DataFrame) -> DataFrame:
    """(term, n_t): rows that hold a term; of equal rows all but one are taken off again."""
    times = settle(times.filter("times > 1"))       # its size decides how the terms are joined
    every = found.select(F.explode("terms").alias("term"), F.lit(1).alias("n"))
    again = (_row_key(found.select("doc_id", "text_key", "terms"))
             .join(times.withColumnsRenamed({"__id": "i", "__key": "k"}),
                   F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k")))
             .groupBy(*ROW).agg(F.first("terms").alias("terms"), F.first("times").alias("times"))
             .select(F.explode("terms").alias("term"), (1 - F.col("times")).alias("n")))
    return every.unionByName(again).groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(found: DataFrame, support: int, disclosure: float) -> DataFrame:
    """(__id, __key, terms): for distinct rows the places of the terms that give away an entity
    of theirs, each with the largest share of one that it gives."""
    times = settle(_row_key(found.select("doc_id", "text_key")).groupBy(*ROW)
                   .agg(F.count("*").alias("times")))
    rows = times.count()
    one = settle(_row_key(found.filter(F.size("spans") > 0)).groupBy(*ROW).agg(
        F.array_distinct(F.transform(F.first("spans"), lambda s: s["entity"])).alias("entities"),
        F.first("places").alias("places")))
    # An entity of fewer rows than `support` has no terms, so most entities end here.
    entities = one.select(*ROW, F.explode("entities").alias("entity"))
    known = _classes(entities, "entity", "e_class", "n_e").filter(
        (F.col("n_e") >= support) & (F.col("n_e") < rows))
    holds_e = settle(entities.join(settle(known), "entity").select(*ROW, "e_class", "n_e").distinct())
    holders = holds_e.select(*ROW).distinct().withColumnsRenamed({"__id": "doc_id",
                                                                  "__key": "text_key"})
    words = settle(one.join(holders, _same_row(), "left_semi")
                   .select(*ROW, F.explode(F.array_distinct(F.transform(
                       "places", lambda p: p["term"]))).alias("term")))
    terms = settle(_classes(words, "term", "t_class", "n_h").filter(F.col("n_h") >= support))
    holds_t = words.join(terms.drop("n_h"), "term").select(F.col("__id").alias("doc_id"), F.col("__key").alias("text_key"),
                           "t_class").distinct()
    together = (holds_e.join(holds_t, _same_row()).groupBy("e_class", "n_e", "t_class")
                .agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support))
    share = (F.log2(F.col("n_te") * F.lit(float(rows)) / F.col("n_t") / F.col("n_e"))
             / F.log2(F.lit(float(rows)) / F.col("n_e")))
    counted = _count_of_terms(found, times).join(terms, "term")
    told = settle(together.join(counted, "t_class")
                  .select("e_class", "term", share.alias("share"))
                  .filter(F.col("share") >= disclosure))
    here = holds_e.select(F.col("__id").alias("doc_id"), F.col("__key").alias("text_key"),
                          F.col("e_class").alias("here"))
    spots = (one.join(holders, _same_row(), "left_semi")
             .select(*ROW, F.explode("places").alias("p")).select(*ROW, "p.*"))
    return settle(spots.join(told, "term")
                  .join(here, _same_row() & (F.col("e_class") == F.col("here")), "left_semi")
                  .groupBy(*ROW, "start", "end").agg(F.max("share").alias("share"))
                  .groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct(
                      "start", F.lit(len(KINDS) - 1).alias("kind"), "end", "share")))
                      .alias("terms")))


def detect(docs: DataFrame, support: int = 2, disclosure: float = 0.8) -> DataFrame:
    """(doc_id, text_key, spans, terms) of every row; a term also has its share."""
    prepare(docs.sparkSession)
    found = settle(analysed(docs))
    marked = disclosing(found, support, disclosure)
    plain = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return (found.select("doc_id", "text_key", plain.alias("spans"))
            .join(marked, _same_row(), "left").select(
                "doc_id", "text_key", "spans", F.coalesce("terms", F.array().cast(
                    "array<struct<start:int,kind:int,end:int,share:double>>")).alias("terms")))


def rewritten(text: Column, marks: Column) -> Column:
    """A text with the marks (start, end, mark) in place of what they cover.

    The marks are taken in blocks, and each block cuts its part off the rest of the text, so a
    text of many marks is not copied once per mark.
    """
    def block(state: Column, first: Column) -> Column:
        def step(inner: Column, s: Column) -> Column:
            return F.when(s["start"] < inner["at"], F.struct(
                F.greatest(inner["at"], s["end"]).alias("at"), inner["out"])).otherwise(F.struct(
                    s["end"].alias("at"), F.concat(inner["out"], F.substring(
                        state["rest"], inner["at"] - state["at"] + 1, s["start"] - inner["at"]),
                        s["mark"]).alias("out")))
        inner = F.aggregate(F.slice(marks, first + 1, F.lit(_BLOCK)),
                            F.struct(state["at"].alias("at"), F.lit("").alias("out")), step)
        return F.get(F.transform(F.array(inner), lambda s: F.struct(
            s["at"].alias("at"),
            F.substring(state["rest"], s["at"] - state["at"] + 1, F.length(state["rest"]))
            .alias("rest"), F.concat(state["out"], F.array(s["out"])).alias("out"))), 0)

    start = F.struct(F.lit(0).alias("at"), text.alias("rest"),
                     F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(marks) - 1, F.lit(_BLOCK)), start, block,
                       lambda s: F.concat(F.array_join(s["out"], ""), s["rest"]))


def sanitise(docs: DataFrame, support: int = 2, disclosure: float = 0.8,
             removal: float = 0.95) -> DataFrame:
    """docs with entities and disclosing terms generalised or removed from the text."""
    columns = docs.columns
    marks = settle(detect(docs, support, disclosure).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"),
        F.array_sort(F.concat(
            F.transform("spans", lambda s: F.struct(
                s["start"], s["end"], F.get(F.array(*(F.lit(f"[{k}]") for k in KINDS)), s["kind"])
                .alias("mark"))),
            F.transform("terms", lambda s: F.struct(
                s["start"], s["end"], F.when(s["share"] >= removal, "").otherwise("[term]")
                .alias("mark"))))).alias("__marks"))
        .filter(F.size("__marks") > 0).dropDuplicates(["__id", "__key"]))
    text = F.col("text")
    clean = rewritten(text, F.col("__marks"))
    joined = docs.join(
        marks.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__key")), "left").withColumn(
        "__clean", F.when(F.col("__marks").isNull(), text).otherwise(clean))
    new = {"text": F.col("__clean")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("__marks").isNull(), F.col("n_chars")).otherwise(
            F.length("__clean")).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(new).select(*columns)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    counts = [_count("spans", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    both = F.array_sort(F.concat("spans", F.transform("terms", lambda s: F.struct(
        s["start"], s["kind"], s["end"]))))
    return found.select("doc_id", *counts, F.sha2(listed(F.col("spans")), 256).alias("base_sha256"),
                        listed(both).alias("spans"), F.size("terms").cast("long").alias("n_term"))
