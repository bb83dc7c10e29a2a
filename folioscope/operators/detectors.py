"""D1-D6. The five detectors and the candidates they nominate together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.text import contains_any
from folioscope.operators.cycles import CycleSearch, cycle_members
from folioscope.operators.presence import key_map, maybe_among
from folioscope.operators.views import invoices_against_bank
from folioscope.settings import Settings


def bought_from_listed(invoices: DataFrame, blacklist: DataFrame) -> DataFrame:
    """D1. Receivers of any invoice, cancelled or not, whose issuer is presumed or final.

    Trade is reduced to distinct pairs before the join with the list.
    """
    listed = blacklist.where(
        F.col("situacion").isin(fv.STATUS_PRESUMED, fv.STATUS_FINAL)
    ).select(F.col("rfc").alias("emisor_rfc"))
    return (invoices.select("emisor_rfc", "receptor_rfc").distinct()
            .join(listed, "emisor_rfc", "left_semi")
            .select(F.col("receptor_rfc").alias("rfc")).distinct())


def unmatched_payments(invoices: DataFrame, ledger: DataFrame,
                       gap: float = Settings.payment_gap) -> DataFrame:
    """D2. Both parties of a valid invoice the bank does not match.

    Books without any bank movement say nothing about payment, so they nominate
    nobody.
    """
    has_movements = ledger.select(F.lit(1)).limit(1).exists()
    off = (invoices_against_bank(invoices, ledger).where(F.abs("discrepancia") > F.lit(gap))
           .where(has_movements))
    return off.select(F.explode(F.array("emisor_rfc", "receptor_rfc")).alias("rfc")).distinct()


def vague_concepts(invoices: DataFrame, items: DataFrame,
                   terms=Settings.vague_terms) -> DataFrame:
    """D4. Receivers of an invoice with a concept that names no deliverable."""
    vague = (items.where(contains_any(F.lower("descripcion"), terms))
             .select(F.col("invoice_uuid").alias("uuid")))
    theirs = maybe_among(invoices.select("uuid", "receptor_rfc"), key_map(vague, F.col("uuid")),
                         F.col("uuid"))
    return (theirs.join(vague, "uuid", "left_semi")
            .select(F.col("receptor_rfc").alias("rfc")).distinct())


def unbacked_transfers(ledger: DataFrame, threshold) -> DataFrame:
    """Transfers without an invoice, of at least the income threshold."""
    return ledger.where(F.col("cfdi_uuid").isNull() & (F.col("monto") >= F.lit(threshold)))


def undeclared_income(ledger: DataFrame, threshold) -> DataFrame:
    """D5. Receivers of such a transfer."""
    return unbacked_transfers(ledger, threshold).select(
        F.col("cuenta_destino_rfc").alias("rfc")).distinct()


def candidates(invoices: DataFrame, items: DataFrame, ledger: DataFrame, blacklist: DataFrame,
               cycles: DataFrame | CycleSearch, income_threshold,
               settings: Settings = Settings()) -> DataFrame:
    """D6. (rfc, detectores), by rfc: every nominated ID with the detectors that nominated it.

    `cycles` are those above the cycle threshold.
    """
    nominated = {
        "D1": bought_from_listed(invoices, blacklist),
        "D2": unmatched_payments(invoices, ledger, settings.payment_gap),
        "D3": cycle_members(cycles),
        "D4": vague_concepts(invoices, items, settings.vague_terms),
        "D5": undeclared_income(ledger, income_threshold),
    }
    tagged = [df.select("rfc", F.lit(name).alias("detector")) for name, df in nominated.items()]
    return (reduce(DataFrame.union, tagged).groupBy("rfc")
            .agg(F.array_sort(F.collect_set("detector")).alias("detectores")).orderBy("rfc"))
