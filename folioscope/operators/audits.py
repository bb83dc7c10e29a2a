"""A1-A6. Check what a text says against the records.

The checks warn and do not block, so silence on a right answer matters as much as
an alarm on a wrong one. Texts have columns answer_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.mentions import (identifiers, literal_mentions, strict_taxids,
                                           taxid_mentions)
from folioscope.functions.text import contains_any, strip
from folioscope.operators.presence import key_map, maybe_among
from folioscope.session import settle


def cited_identifiers(texts: DataFrame) -> DataFrame:
    """A1. (answer_id, id): folios and tax IDs in each text."""
    return texts.select("answer_id", F.explode(identifiers(F.col("text"))).alias("id"))


def invented_identifiers(answers: DataFrame, seen: DataFrame) -> DataFrame:
    """A2. (answer_id, id): identifiers an answer cites that were never seen.

    Seen is what the case text and the tool results showed (`seen`: answer_id, id)
    and what the question itself wrote (`answers.question`). Only what may have been
    cited of it is shuffled.
    """
    cited = F.array_except(identifiers(F.col("text")),
                           identifiers(F.coalesce("question", F.lit(""))))
    named = settle(answers.select("answer_id", F.explode(cited).alias("id")))
    pair = F.col("answer_id").cast("string"), F.col("id")
    asked = maybe_among(seen.select("answer_id", "id"), key_map(named, *pair), *pair)
    return named.join(asked, ["answer_id", "id"], "left_anti")


def seen_identifiers(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(answer_id, id): what A2 takes as seen. `answers` has answer_id and lead_id, `shown` has
    lead_id and texto: the lines of the case text (R2) and of tool results."""
    cited = shown.select("lead_id", F.explode(identifiers(F.col("texto"))).alias("id")).distinct()
    return answers.select("answer_id", "lead_id").join(cited, "lead_id").select("answer_id", "id")


def odd_shaped(confirmed: DataFrame, column: str = "rfc_imputado") -> DataFrame:
    """(rfc): confirmed IDs of another shape than a tax ID's; A3 and A5 search them as literals."""
    own = strip(F.col(column))
    return confirmed.select(own.alias("rfc")).where(
        (F.col("rfc") != "") & ~F.upper("rfc").rlike(f"^{fv.TAXID_SHAPE}$")).distinct()


def denied_cases(texts: DataFrame, confirmed: DataFrame) -> DataFrame:
    """A3. (answer_id, rfc): confirmed IDs a text presents as not accused.

    A negation counts within the 140 characters before the ID and in its sentence. Letter
    case does not count, and the IDs come out in upper case.
    """
    confirmed = settle(confirmed.select("rfc_imputado"))     # read for either shape
    shaped = taxid_mentions(texts, "answer_id", "text", fv.NEGATION_WINDOW)
    odd = odd_shaped(confirmed).select(F.lower("rfc").alias("rfc"))
    others = literal_mentions(texts.select("answer_id", F.lower("text").alias("text")),
                              "answer_id", "text", odd, fv.NEGATION_WINDOW)

    def denied(found: DataFrame) -> DataFrame:
        sentence = F.element_at(F.split(F.lower("before"), fv.SENTENCE_ENDS, -1), -1)
        return found.where(contains_any(sentence, fv.NEGATIONS)).select(
            "answer_id", F.upper("rfc").alias("rfc")).distinct()
    known = denied(shaped).join(
        confirmed.select(F.upper(strip(F.col("rfc_imputado"))).alias("rfc")), "rfc", "left_semi")
    return known.unionByName(denied(others)).select("answer_id", "rfc")


def wrong_list_status(texts: DataFrame, blacklist: DataFrame) -> DataFrame:
    """A4. (answer_id, rfc, situacion): listed IDs whose status a text states wrongly.

    Around any occurrence (180 characters each way) the text says only the other of
    presumed and final. IDs count when they stand as a word somewhere in the text. Texts are
    read once: an ID that stands as a word is also a mention, which says so.
    """
    whole = texts.where("answer_id is not null").select(
        F.struct("answer_id", strict_taxids(F.col("text")).alias("words")).alias("of"), "text")
    found = taxid_mentions(whole, "of", "text", fv.STATUS_WINDOW)
    around = F.lower(F.concat("before", "rfc", "after"))
    says_presumed = F.contains(around, F.lit(fv.SAYS_PRESUMED))
    says_final = F.contains(around, F.lit(fv.SAYS_FINAL))
    listed = blacklist.where(
        F.col("situacion").isin(fv.STATUS_PRESUMED, fv.STATUS_FINAL)).select("rfc", "situacion")
    mentions = found.withColumn("rfc", F.upper("rfc")).withColumn(
        "around", around)
    may_be = maybe_among(mentions, key_map(listed, F.col("rfc")), F.col("rfc"))
    said = may_be.groupBy(F.col("of.answer_id").alias("answer_id"), "rfc").agg(
        F.max(F.array_contains("of.words", F.col("rfc"))).alias("named"),
        F.max(says_presumed & ~says_final).alias("presumed"),
        F.max(says_final & ~says_presumed).alias("final")).where("named")
    other = F.when(F.col("situacion") == fv.STATUS_PRESUMED, F.col("final")).otherwise(
        F.col("presumed"))
    return said.join(listed, "rfc").where(other).select("answer_id", "rfc", "situacion")


def case_amounts(confirmed: DataFrame, resolved: DataFrame) -> DataFrame:
    """(rfc, monto): the total and the cited amounts of each confirmed ID."""
    totals = confirmed.select(
        F.col("rfc_imputado").alias("rfc"),
        F.col("monto_total_evidencia").cast("decimal(24,2)").alias("monto"))
    rows = resolved.join(confirmed.select("lead_id"), "lead_id", "left_semi").select(
        F.col("rfc_imputado").alias("rfc"), F.col("monto").cast("decimal(24,2)").alias("monto"))
    return totals.unionByName(rows).where("monto is not null").distinct()


def swapped_amounts(texts: DataFrame, amounts: DataFrame) -> DataFrame:
    """A5. (answer_id, rfc, monto, dueno, n_duenos): an amount near a confirmed ID that is
    another's.

    Within 120 characters of the ID, exact letter case. One row per text and ID, with the
    first such amount, the first case that has it, and how many have it; `amount_owners`
    lists them. An amount no case has is not reported, it may come from a legitimate
    query.
    """
    wanted = ["answer_id", "ordinal", "rfc", "before", "after"]
    found = taxid_mentions(texts, "answer_id", "text", fv.MONEY_WINDOW).select(
        "answer_id", F.col("ordinal").cast("long").alias("ordinal"), "rfc", "before", "after")
    found = found.unionByName(literal_mentions(
        texts, "answer_id", "text", odd_shaped(amounts, "rfc"), fv.MONEY_WINDOW).select(*wanted))
    # Amounts are only sought around IDs that may be confirmed; most mentions are of others.
    accused = amounts.select("rfc").distinct()
    found = maybe_among(found, key_map(accused, F.col("rfc")), F.col("rfc"))
    around = F.concat("before", "rfc", "after")
    figures = found.select(
        "answer_id", "rfc", "ordinal",
        F.posexplode(F.regexp_extract_all(around, F.lit(fv.MONEY_PATTERN), F.lit(1)))
        .alias("place", "figure")).select(
        "answer_id", "rfc", "ordinal", "place",
        F.replace("figure", F.lit(","), F.lit("")).try_cast("decimal(24,2)").alias("monto"))
    owners = amount_owners(amounts).groupBy("monto").agg(
        F.min("dueno").alias("dueno"), F.count("*").alias("n_duenos"))
    foreign = (figures.join(accused, "rfc", "left_semi")
               .join(amounts, ["rfc", "monto"], "left_anti")
               .join(owners, "monto", "left_semi"))
    first = foreign.groupBy("answer_id", "rfc").agg(
        F.min(F.struct("ordinal", "place", "monto")).alias("f")).select(
        "answer_id", "rfc", F.col("f.monto").alias("monto"))
    return first.join(owners, "monto").select("answer_id", "rfc", "monto", "dueno", "n_duenos")


def amount_owners(amounts: DataFrame) -> DataFrame:
    """(monto, dueno): the cases that have each amount."""
    return amounts.select("monto", F.col("rfc").alias("dueno")).distinct()


def reconcile_report(lines: DataFrame, invoices: DataFrame, ledger: DataFrame,
                     entities: DataFrame, totals: DataFrame) -> DataFrame:
    """A6. (clase, valor, existe): every identifier and figure a report holds, and whether
    the records have it. `totals` has a column monto with the totals of the cases.

    Records are tested against a map of what the report mentions where they are read; what
    passes is reduced to distinct values and looked up exactly.
    """
    ids = settle(lines.select(F.explode(identifiers(F.col("texto"))).alias("valor")).distinct())
    figures = lines.select(F.explode(F.regexp_extract_all(
        F.col("texto"), F.lit(fv.MONEY_PATTERN), F.lit(1))).alias("valor")).distinct()
    records = (invoices.select(F.col("uuid").alias("valor"))
               .union(ledger.select("tx_id")).union(entities.select("rfc")))
    known_ids = (maybe_among(records, key_map(ids, F.col("valor")), F.col("valor"))
                 .distinct().join(ids, "valor", "left_semi"))
    money = lambda c: F.col(c).cast("decimal(24,2)").alias("monto")
    cited = settle(figures.select("valor", F.replace("valor", F.lit(","), F.lit(""))
                                  .try_cast("decimal(24,2)").alias("monto")))
    amounts = (invoices.select(money("total")).union(ledger.select(money("monto")))
               .union(totals.select(money("monto"))))
    known_money = (maybe_among(amounts, key_map(cited, F.col("monto")), F.col("monto"))
                   .distinct().join(cited.select("monto"), "monto", "left_semi"))
    found = F.coalesce("_found", F.lit(False)).alias("existe")
    id_rows = ids.join(known_ids.withColumn("_found", F.lit(True)), "valor", "left").select(
        F.when(F.col("valor").rlike(f"^{fv.UUID_PATTERN}$"), "FOLIO").otherwise("RFC")
        .alias("clase"), "valor", found)
    money_rows = cited.join(known_money.withColumn("_found", F.lit(True)), "monto", "left").select(
        F.lit("MONTO").alias("clase"), "valor", found)
    return id_rows.unionByName(money_rows)
