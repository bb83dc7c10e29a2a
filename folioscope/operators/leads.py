"""E8-E10. Dossiers, deterministic lead proposals, and dropping invented citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.folios import packed, unpacked
from folioscope.operators.blacklist import finally_listed, status_lookup
from folioscope.operators.cycles import CycleSearch, cycle_legs, cycle_members, cycle_of
from folioscope.operators.detectors import unbacked_transfers
from folioscope.operators.evidence import cited_id
from folioscope.operators.presence import key_map, maybe_among

RULES = {
    "EFOS_69B": "Artículo 69-B del CFF",
    "KICKBACK_CIRCULAR": "Artículo 400 Bis del CPF",
    "INGRESO_NO_DECLARADO": "Artículo 59 del CFF",
    "EMPRESA_FACHADA": "Artículo 69-B del CFF",
    "SIN_MATERIALIDAD": "Artículo 5-A del CFF",
}


def dossier(rfcs: DataFrame, invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """E8a. Every invoice an ID is a party of, with the transfers tied to it."""
    sides = (invoices.withColumn("rfc", F.explode(F.array_distinct(
        F.array("emisor_rfc", "receptor_rfc"))))
        .join(rfcs.select("rfc").distinct(), "rfc", "left_semi"))
    tied = ledger.where(F.col("cfdi_uuid").isNotNull()).select(
        F.col("cfdi_uuid").alias("uuid"), "tx_id", "monto", "fecha_hora")
    return sides.select("rfc", "uuid", "emisor_rfc", "receptor_rfc", "total").join(
        tied, "uuid", "left")


def suppliers_with_status(rfcs: DataFrame, invoices: DataFrame, blacklist: DataFrame) -> DataFrame:
    """E8b. Distinct issuers an ID bought from, with their list status."""
    bought = (invoices.select(F.col("receptor_rfc").alias("comprador"),
                              F.col("emisor_rfc").alias("rfc")).distinct()
              .join(rfcs.select(F.col("rfc").alias("comprador")).distinct(), "comprador",
                    "left_semi"))
    return status_lookup(bought, blacklist)


def income_without_invoice(ledger: DataFrame) -> DataFrame:
    """E8c. Per ID, the transfers received without an invoice."""
    return (ledger.where(F.col("cfdi_uuid").isNull())
            .groupBy(F.col("cuenta_destino_rfc").alias("rfc"))
            .agg(F.count("*").alias("n"), F.sum("monto").alias("total"),
                 F.max("monto").alias("mayor")))


def counterparty_ledger(rfcs: DataFrame, ledger: DataFrame) -> DataFrame:
    """E8d. Every transfer an ID sent or received."""
    sides = ledger.select(
        F.explode(F.array_distinct(F.array("cuenta_origen_rfc", "cuenta_destino_rfc")))
        .alias("rfc"), "tx_id", "cuenta_origen_rfc", "cuenta_destino_rfc", "monto")
    return sides.join(rfcs.select("rfc").distinct(), "rfc", "left_semi")


def ranked_cases(cases: DataFrame) -> DataFrame:
    """E8e. Confirmed cases, largest amount first."""
    return (cases.where(F.col("estatus_dictamen") == fv.CONFIRMED)
            .select("rfc_imputado", "tipo_esquema", "monto_total_evidencia")
            .orderBy(F.desc("monto_total_evidencia"), "rfc_imputado"))


def cases_by_scheme(cases: DataFrame) -> DataFrame:
    """E8e. Number, largest and smallest amount of the confirmed cases per scheme."""
    return (cases.where(F.col("estatus_dictamen") == fv.CONFIRMED).groupBy("tipo_esquema")
            .agg(F.count("*").alias("n"), F.max("monto_total_evidencia").alias("mayor"),
                 F.min("monto_total_evidencia").alias("menor")))


def scheme_evidence(invoices: DataFrame, ledger: DataFrame, blacklist: DataFrame,
                    cycles: DataFrame | CycleSearch, immaterial: DataFrame,
                    income_threshold) -> DataFrame:
    """(rfc, prioridad, tipo, uuid, tx_id): the rows that prove a scheme, for every ID.

    A company that issues no invoice of its own is a front (EMPRESA_FACHADA) where
    another would lack substance (SIN_MATERIALIDAD).
    """
    none = F.lit(None).cast("string")

    def bill_rows(df, priority):
        return df.select(F.col("rfc"), priority.alias("prioridad"),
                         F.lit(fv.INVOICE_KIND).alias("tipo"), "uuid", none.alias("tx_id"))

    def transfer_rows(df, rfc, priority):
        return df.select(rfc.alias("rfc"), F.lit(priority).alias("prioridad"),
                         F.lit(fv.TRANSFER_KIND).alias("tipo"), none.alias("uuid"), "tx_id")

    listed = finally_listed(blacklist).select(F.col("rfc").alias("emisor_rfc"))
    from_listed = invoices.select("uuid", "emisor_rfc", F.col("receptor_rfc").alias("rfc")).join(
        listed, "emisor_rfc", "left_semi")

    legs = cycle_legs(cycle_of(cycle_members(cycles), cycles), "rfc").where(
        (F.col("rfc") == F.col("origen")) | (F.col("rfc") == F.col("destino")))
    on_legs = ledger.select("tx_id", F.col("cuenta_origen_rfc").alias("origen"),
                            F.col("cuenta_destino_rfc").alias("destino")).join(
        legs.select("rfc", "origen", "destino"), ["origen", "destino"])

    sells = invoices.select(F.col("emisor_rfc").alias("rfc"),
                            F.lit(True).alias("vende")).distinct()
    hollow = immaterial.join(sells, "rfc", "left")
    return reduce(DataFrame.unionByName, [
        bill_rows(from_listed, F.lit(1)),
        transfer_rows(on_legs, F.col("rfc"), 2),
        transfer_rows(unbacked_transfers(ledger, income_threshold),
                      F.col("cuenta_destino_rfc"), 3),
        bill_rows(hollow, F.when(F.col("vende"), F.lit(5)).otherwise(F.lit(4))),
    ])


def propose_leads(candidates: DataFrame, proving_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E9. One lead per candidate: its strongest scheme and the rows that prove it.

    A candidate without any such row gets an empty scheme and no evidence, which
    the verdict then refuses. Returns (leads, evidence); the lead's ID is the RFC.
    """
    strongest = proving_rows.groupBy("rfc").agg(F.min("prioridad").alias("prioridad"))
    chosen = candidates.select("rfc").join(strongest, "rfc", "left")
    scheme = F.get(F.array(*[F.lit(s) for s in fv.SCHEMES]), F.col("prioridad") - 1)
    rule = F.get(F.array(*[F.lit(RULES[s]) for s in fv.SCHEMES]), F.col("prioridad") - 1)
    leads = chosen.select(
        F.col("rfc").alias("lead_id"), F.col("rfc").alias("rfc_imputado"),
        F.coalesce(scheme, F.lit("")).alias("tipo_esquema"),
        F.coalesce(rule, F.lit("")).alias("regla_fiscal"),
        F.when(F.col("prioridad").isNull(), F.lit("Sin filas que prueben un esquema."))
        .otherwise(F.concat(F.lit("Filas que prueban "), scheme)).alias("narrativa"))
    short = {c: packed(F.col(c)) for c in ("uuid", "tx_id")}
    evidence = proving_rows.withColumns(short).join(
        chosen.where(F.col("prioridad").isNotNull()), ["rfc", "prioridad"], "left_semi").select(
        F.col("rfc").alias("lead_id"), F.col("rfc").alias("rfc_imputado"),
        F.lit(0).cast("long").alias("pos"), "tipo",
        *[unpacked(F.col(c)).alias(c) for c in short])
    return leads, evidence


def drop_unseen(leads: DataFrame, evidence: DataFrame,
                seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E10. Remove citations of identifiers that were never seen (`seen.id`).

    A lead that loses all its evidence becomes the default lead with the reason; a
    lead that cited nothing stays as it is.
    """
    cited = evidence.withColumn("id", cited_id())
    named = F.col("id").isNotNull() & (F.col("id") != "")
    short = {c: packed(F.col(c)) for c in ("id", "uuid", "tx_id")}
    sought = cited.where(named).withColumns(short)
    known = maybe_among(seen.select(packed(F.col("id")).alias("id")), key_map(sought, F.col("id")),
                        F.col("id")).distinct().withColumn("_seen", F.lit(True))
    marked = sought.join(known, "id", "left").withColumns({c: unpacked(F.col(c)) for c in short})
    kept = marked.where("_seen").select(*evidence.columns)
    kept = kept.unionByName(cited.where(~F.coalesce(named, F.lit(False))).select(*evidence.columns))
    emptied = (marked.groupBy("lead_id")
               .agg(F.count("_seen").alias("vistos"), F.min("id").alias("primero"),
                    F.count("*").alias("citados"))
               .where(F.col("vistos") == 0).select("lead_id", "primero", "citados"))
    blanks_left = (cited.where(~F.coalesce(named, F.lit(False))).select("lead_id").distinct())
    emptied = emptied.join(blanks_left, "lead_id", "left_anti")
    hit = F.col("primero").isNotNull()
    fixed = leads.join(emptied, "lead_id", "left").select(
        "lead_id", "rfc_imputado",
        F.when(hit, F.lit("SIN_MATERIALIDAD")).otherwise(F.col("tipo_esquema"))
        .alias("tipo_esquema"),
        F.when(hit, F.lit("")).otherwise(F.col("regla_fiscal")).alias("regla_fiscal"),
        F.when(hit, F.format_string(
            "Citó %s identificadores inexistentes, empezando por %s.",
            F.col("citados").cast("string"), F.col("primero")))
        .otherwise(F.col("narrativa")).alias("narrativa"))
    return fixed, kept
