"""The two shared views: the money network, and invoices against the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.folios import packed, unpacked


def money_network(ledger: DataFrame) -> DataFrame:
    """V1. One row per (source, target): total moved and number of transfers, over all time."""
    return ledger.groupBy(
        F.col("cuenta_origen_rfc").alias("source"),
        F.col("cuenta_destino_rfc").alias("target"),
    ).agg(F.sum("monto").alias("total_transferido"),
          F.count("tx_id").alias("numero_operaciones"))


def invoices_against_bank(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """V2. Valid invoices with what the bank paid for each.

    Payments are summed per invoice before the join, so the join is one to one
    and a folio that half the ledger refers to costs no fan-out.
    """
    paid = (ledger.where(F.col("cfdi_uuid").isNotNull())
            .groupBy(packed(F.col("cfdi_uuid")).alias("_key"))
            .agg(F.sum("monto").alias("paid")))
    zero = F.lit(0).cast("decimal(24,2)")
    monto_pagado = F.coalesce(F.col("paid"), zero)
    billed = invoices.where(F.col("estado_cfdi") == "VIGENTE").select(
        packed(F.col("uuid")).alias("_key"), "emisor_rfc", "receptor_rfc", "total")
    return (billed.join(paid, "_key", "left")
            .select(unpacked(F.col("_key")).alias("uuid"), "emisor_rfc", "receptor_rfc",
                    F.col("total").alias("monto_facturado"),
                    monto_pagado.alias("monto_pagado"),
                    (F.col("total") - monto_pagado).alias("discrepancia")))
