"""E1-E7. From cited identifiers to a verdict.

Leads and evidence are two flat tables, so a lead may cite any number of rows:

    leads     lead_id, rfc_imputado, tipo_esquema, regla_fiscal, narrativa
    evidence  lead_id, rfc_imputado, pos, tipo, uuid, tx_id

`pos` is the place of the item in the draft and survives every step, because a
refusal names the first bad item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.folios import packed, unpacked
from folioscope.functions.text import blank, money_text, strip
from folioscope.operators.blacklist import finally_listed
from folioscope.operators.presence import among, key_map, maybe_among
from folioscope.session import settle


def flat_leads(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split nested drafts (lead_id plus the draft fields) into leads and evidence."""
    leads = drafts.select("lead_id", "rfc_imputado", "tipo_esquema", "regla_fiscal", "narrativa")
    evidence = drafts.select(
        "lead_id", "rfc_imputado", F.posexplode("evidencia").alias("pos", "e")).select(
        "lead_id", "rfc_imputado", F.col("pos").cast("long").alias("pos"), "e.*")
    return leads, evidence


def cited_id(uuid: str = "uuid", tx_id: str = "tx_id") -> Column:
    return F.when(F.col(uuid) != "", F.col(uuid)).otherwise(F.col(tx_id))


def resolve_evidence(evidence: DataFrame, invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """E1, E2. Attach what the books say about each cited row.

    An item without identifier is skipped. The identifier decides the kind when
    the label does not. `contado_en_total` is false for a transfer that pays an
    invoice the same lead cites: that is the same money.
    """
    kind = F.when(F.col("tipo").isin(fv.INVOICE_KIND, fv.TRANSFER_KIND), F.col("tipo")).otherwise(
        F.when(F.col("uuid") != "", F.lit(fv.INVOICE_KIND)).otherwise(F.lit(fv.TRANSFER_KIND)))
    # An item is shown under the identifier it is looked up by, if it has that one.
    own = F.when(F.col("tipo") == fv.TRANSFER_KIND, cited_id("tx_id", "uuid")).otherwise(cited_id())
    key = F.when(F.col("tipo") == fv.INVOICE_KIND, F.col("uuid")).otherwise(F.col("tx_id"))
    # Read for each kind, for the maps of the keys and for the joins. `_else` is the identifier of
    # a row that is shown under another one than it is looked up by. What has no identifier gets
    # no kind, so nothing seeks it: a filter here would be worked out below the identifiers, which
    # makes each of them many times over.
    cited = settle(evidence.withColumn("tipo", kind).withColumn("id", own).withColumn("key", key)
                   .select(
        "lead_id", "rfc_imputado", "pos",
        F.when(~blank(F.col("id")), F.col("tipo")).alias("tipo"),
        packed(F.col("key")).alias("_key"),
        F.when(F.col("id") == F.col("key"), F.lit(None)).otherwise(F.col("id")).alias("_else")))
    accused = F.col("rfc_imputado")

    none = F.lit(None).cast("string")
    bill_keys = _sought(cited, fv.INVOICE_KIND)
    bills = _with_ids(_matched(bill_keys, invoices.select(
        packed(F.col("uuid")).alias("_key"), F.col("emisor_rfc").alias("de_rfc"),
        F.col("receptor_rfc").alias("a_rfc"), F.col("total").alias("monto"),
        none.alias("cfdi_uuid")))).select(
        "lead_id", "rfc_imputado", "pos", F.lit(fv.INVOICE_KIND).alias("tipo"), "id",
        F.col("_own").alias("uuid"), none.alias("tx_id"), "monto", "_found", "de_rfc", "a_rfc",
        "cfdi_uuid")
    # Read twice: to be shown, and for the invoices they pay. Kept by their short keys.
    moves = settle(_matched(_sought(cited, fv.TRANSFER_KIND), ledger.select(
        packed(F.col("tx_id")).alias("_key"), F.col("cuenta_origen_rfc").alias("de_rfc"),
        F.col("cuenta_destino_rfc").alias("a_rfc"), "monto",
        packed(F.col("cfdi_uuid")).alias("_paid"))))

    def shown(found: DataFrame, cfdi_uuid: Column, *more: str) -> DataFrame:
        return _with_ids(found).select(
            "lead_id", "rfc_imputado", "pos", F.lit(fv.TRANSFER_KIND).alias("tipo"), "id",
            none.alias("uuid"), F.col("_own").alias("tx_id"), "monto", "_found", "de_rfc",
            "a_rfc", cfdi_uuid.alias("cfdi_uuid"), *more)
    backed = moves.where(F.col("_paid").isNotNull())
    paid = backed.select("lead_id", F.col("_paid").alias("_key"))
    cited_bills = _cited_bills(bill_keys, paid, invoices).select(
        "lead_id", F.col("_key").alias("_paid"), F.lit(True).alias("_pays"))
    backed = shown(backed, unpacked(F.col("_paid")), "_paid").join(
        cited_bills, ["lead_id", "_paid"], "left").drop("_paid")
    unbacked = shown(moves.where(F.col("_paid").isNull()), none)
    everything = (bills.withColumn("_pays", F.lit(None).cast("boolean"))
                  .unionByName(backed)
                  .unionByName(unbacked.withColumn("_pays", F.lit(None).cast("boolean"))))
    exists = F.coalesce("_found", F.lit(False))
    relevant = exists & F.coalesce(
        (accused == F.col("de_rfc")) | (accused == F.col("a_rfc")), F.lit(False))
    return everything.select(
        "lead_id", "rfc_imputado", "pos", "tipo", "id", "uuid", "tx_id", "monto",
        exists.alias("existe"), relevant.alias("relevante"), "de_rfc", "a_rfc", "cfdi_uuid",
        (relevant & F.col("_pays").isNull()).alias("contado_en_total"))


def keep_resolved(resolved: DataFrame) -> DataFrame:
    """Resolved rows that several later steps read, settled without saying anything twice.

    The identifier a row is shown under mostly is the one it was looked up by, and one of its
    parties the accused; those are marks in what is written.
    """
    accused = F.col("rfc_imputado")
    own = F.when(F.col("tipo") == fv.INVOICE_KIND, F.col("uuid")).otherwise(F.col("tx_id"))
    same = {"_same_id": (F.col("id"), own), "_same_de": (F.col("de_rfc"), accused),
            "_same_a": (F.col("a_rfc"), accused)}
    said = resolved.withColumns({m: this.eqNullSafe(that) for m, (this, that) in same.items()})
    names = {"_same_id": "id", "_same_de": "de_rfc", "_same_a": "a_rfc"}
    kept = settle(said.withColumns({n: F.when(~F.col(m), F.col(n)) for m, n in names.items()}))
    return kept.withColumns({names[m]: F.when(F.col(m), that).otherwise(F.col(names[m]))
                             for m, (_, that) in same.items()}).select(*resolved.columns)


def _sought(cited: DataFrame, kind: str) -> DataFrame:
    """The cited rows of one kind."""
    return cited.where(F.col("tipo") == kind).drop("tipo")


def _matched(sought: DataFrame, records: DataFrame) -> DataFrame:
    """Each sought row with its record, if there is one. Only records that may be sought move."""
    may_be = maybe_among(records, key_map(sought, F.col("_key")), F.col("_key"))
    return sought.join(may_be.withColumn("_found", F.lit(True)), "_key", "left")


def _with_ids(matched: DataFrame) -> DataFrame:
    """What was looked up under (`_own`), and what it is shown under (`id`)."""
    own = unpacked(F.col("_key"))
    return matched.withColumns({"_own": own, "id": F.coalesce("_else", own)})


def _cited_bills(bill_keys: DataFrame, paid: DataFrame, invoices: DataFrame) -> DataFrame:
    """(lead_id, _key): the invoices there are that pay for a transfer of the lead that cites both.

    Either side is cut down to what the other may hold before they meet.
    """
    pair = F.col("lead_id"), F.col("_key")
    near = settle(maybe_among(bill_keys.select("lead_id", "_key"), key_map(paid, *pair), *pair))
    both = settle(near.join(maybe_among(paid, key_map(near, *pair), *pair),
                            ["lead_id", "_key"], "left_semi").distinct())
    there = invoices.select(packed(F.col("uuid")).alias("_key"))
    return both.join(maybe_among(there, key_map(both, F.col("_key")), F.col("_key")), "_key",
                     "left_semi").select("lead_id", "_key")


def evidence_totals(resolved: DataFrame) -> DataFrame:
    """E2. Countable total per lead."""
    counted = F.when(F.col("contado_en_total"), F.col("monto"))
    return resolved.groupBy("lead_id").agg(
        F.coalesce(F.sum(counted), F.lit(0)).cast("decimal(24,2)")
        .alias("monto_total_evidencia"))


def mark_proofs(resolved: DataFrame, blacklist: DataFrame, immaterial: DataFrame,
                income_threshold) -> DataFrame:
    """E4, E6, E7. Which cited rows carry the proof of which scheme.

    E4 looks at the other party of a cited invoice, whichever side the accused is
    on. E6 and E7 need the accused to be the receiver.
    """
    is_bill = F.col("existe") & (F.col("tipo") == fv.INVOICE_KIND)
    received = F.col("a_rfc") == F.col("rfc_imputado")
    other = F.when(received, F.col("de_rfc")).otherwise(F.col("a_rfc"))
    bills = resolved.where(is_bill).withColumn("contraparte", other)
    bills = bills.join(
        finally_listed(blacklist).select(F.col("rfc").alias("contraparte"),
                                         F.lit(True).alias("_listed")), "contraparte", "left")
    no, pair = F.lit(False), (F.col("uuid"), F.col("rfc_imputado"))
    hollow = immaterial.select("uuid", F.col("rfc").alias("rfc_imputado"))
    bills = among(bills, key_map(hollow, *pair), "_maybe", *pair)
    # Only what may be immaterial is shuffled to find out.
    bills = bills.where("_maybe").join(
        hollow.withColumn("_immaterial", F.lit(True)), ["uuid", "rfc_imputado"], "left"
    ).unionByName(bills.where(~F.col("_maybe")).withColumn("_immaterial", F.lit(None).cast("boolean")))
    bills = bills.select(
        *resolved.columns, F.coalesce("_listed", no).alias("prueba_69b"),
        F.coalesce("_immaterial", no).alias("prueba_materialidad"),
        no.alias("prueba_ingreso"))
    income = (F.col("existe") & (F.col("tipo") == fv.TRANSFER_KIND) & received
              & F.col("cfdi_uuid").isNull() & (F.col("monto") >= F.lit(income_threshold)))
    others = resolved.where(~is_bill).select(
        "*", no.alias("prueba_69b"), no.alias("prueba_materialidad"),
        F.coalesce(income, no).alias("prueba_ingreso"))
    return bills.unionByName(others)


def verdicts(leads: DataFrame, marked: DataFrame, entities: DataFrame, members: DataFrame,
             income_threshold) -> DataFrame:
    """E3. The first rule a lead fails is its reason; a lead that passes all is confirmed.

    `marked` comes from `mark_proofs`; `members` are the IDs in any cycle above the
    proof's own minimum leg (E5), which is lower than the detector's on purpose.
    """
    bad_id = F.struct("pos", "id")
    counted = F.when(F.col("contado_en_total"), F.col("monto"))
    per_lead = marked.groupBy("lead_id").agg(
        F.count("*").alias("n"),
        F.min(F.when(~F.col("existe"), bad_id)).alias("ausente"),
        F.min(F.when(F.col("existe") & ~F.col("relevante"), bad_id)).alias("ajena"),
        F.sum(counted).alias("total"),
        F.max("prueba_69b").alias("prueba_69b"),
        F.max("prueba_materialidad").alias("prueba_materialidad"),
        F.max("prueba_ingreso").alias("prueba_ingreso"))
    names = entities.select(F.col("rfc").alias("rfc_imputado"), F.col("razon_social")
                            .alias("_name"), F.lit(True).alias("_entity"))
    circular = members.select(F.col("rfc").alias("rfc_imputado"),
                              F.lit(True).alias("prueba_ciclo"))
    full = (leads.join(per_lead, "lead_id", "left").join(names, "rfc_imputado", "left")
            .join(circular, "rfc_imputado", "left"))

    scheme, rfc, no = F.col("tipo_esquema"), F.col("rfc_imputado"), F.lit(False)
    total = F.coalesce("total", F.lit(0)).cast("decimal(24,2)")

    def lacks(proof: str) -> Column:
        return ~F.coalesce(proof, no)

    said = F.format_string
    rules = [
        ("CAMPOS_FALTANTES", rfc.isNull() | scheme.isNull(),
         F.lit("el lead está incompleto.")),
        ("RFC_DESCONOCIDO", F.col("_entity").isNull(),
         said("el RFC imputado '%s' no existe en los libros.", rfc)),
        ("SIN_TIPIFICAR", strip(scheme) == "",
         said("la revisión de %s no tipificó ningún esquema; no hay acusación.", rfc)),
        ("ESQUEMA_DESCONOCIDO", ~scheme.isin(*fv.SCHEMES),
         said("'%s' no es una tipología reconocida (%s).", scheme,
              F.lit(", ".join(sorted(fv.SCHEMES))))),
        ("SIN_EVIDENCIA", F.col("n").isNull(),
         F.lit("no hay evidencia referenciada.")),
        ("EVIDENCIA_INEXISTENTE", F.col("ausente").isNotNull(),
         said("la evidencia citada '%s' no existe en los libros.", F.col("ausente.id"))),
        ("EVIDENCIA_AJENA", F.col("ajena").isNotNull(),
         said("la evidencia '%s' existe pero no involucra a %s.", F.col("ajena.id"), rfc)),
        ("MONTO_NO_POSITIVO", total <= 0,
         F.lit("la evidencia verificada no suma un monto mayor a cero.")),
        ("SIN_PRUEBA_69B", (scheme == "EFOS_69B") & lacks("prueba_69b"),
         F.lit("ninguna factura citada tiene una contraparte DEFINITIVO en la lista 69-B.")),
        ("SIN_PRUEBA_CICLO", (scheme == "KICKBACK_CIRCULAR") & lacks("prueba_ciclo"),
         said("ningún ciclo de transferencias incluye a %s.", rfc)),
        ("SIN_PRUEBA_INGRESO", (scheme == "INGRESO_NO_DECLARADO") & lacks("prueba_ingreso"),
         said("ninguna transferencia citada entró a %s sin CFDI por al menos %s.", rfc,
              money_text(F.lit(income_threshold)))),
        ("SIN_PRUEBA_MATERIALIDAD",
         scheme.isin("SIN_MATERIALIDAD", "EMPRESA_FACHADA") & lacks("prueba_materialidad"),
         said("ninguna inconsistencia de materialidad verificable para %s.", rfc)),
    ]
    code = reason = None
    for name, failed, text in rules:
        text = F.concat(F.lit(fv.REJECTED + ": "), text)
        code = F.when(failed, name) if code is None else code.when(failed, name)
        reason = F.when(failed, text) if reason is None else reason.when(failed, text)
    return full.select(
        "lead_id", "rfc_imputado", F.coalesce("_name", F.lit("")).alias("razon_social"),
        "tipo_esquema", "regla_fiscal", "narrativa", total.alias("monto_total_evidencia"),
        code.isNull().alias("confirmado"),
        F.when(code.isNull(), fv.CONFIRMED).otherwise(fv.REJECTED).alias("estatus_dictamen"),
        F.coalesce(code, F.lit("")).alias("regla_fallida"),
        F.coalesce(reason, F.lit(fv.CONFIRMED)).alias("razon"))
