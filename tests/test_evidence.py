import datetime as dt
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from folioscope import schema
from folioscope.functions.folios import packed, unpacked
from folioscope.operators import evidence, leads
from folioscope.settings import Settings

A, B, C = "AAA010101AAA", "BBB010101BBB", "CCC010101CCC"
DAY = dt.datetime(2024, 1, 1)
LEAD = "lead_id string, rfc_imputado string, tipo_esquema string, regla_fiscal string, " \
       "narrativa string"
EVIDENCE = "lead_id string, rfc_imputado string, pos long, tipo string, uuid string, tx_id string"


@pytest.fixture(scope="module")
def books(spark):
    money = Decimal
    return {
        "entities": spark.createDataFrame(
            [(r, f"Empresa {r}", None, None, "00000", False) for r in (A, B, C)], schema.ENTITIES),
        "blacklist": spark.createDataFrame(
            [(B, "DEFINITIVO", dt.date(2024, 1, 1), money(0))], schema.BLACKLIST),
        "invoices": spark.createDataFrame(
            [(u, e, r, DAY, money(t), money(t), "PUE", "03", "VIGENTE") for u, e, r, t in [
                ("f1", B, A, "100.10"), ("f2", C, A, "50"), ("f3", B, C, "70"), ("f0", C, A, "0"),
                ("f4", A, B, "20")]], schema.INVOICES),
        "ledger": spark.createDataFrame(
            [(t, o, d, DAY, money(m), None, f) for t, o, d, m, f in [
                ("t1", A, B, "100.10", "f1"), ("t2", C, A, "9000", None),
                ("t3", C, A, "10", None), ("t4", B, C, "5", None)]], schema.LEDGER),
        "immaterial": spark.createDataFrame([("f2", A)], "uuid string, rfc string"),
        "members": spark.createDataFrame([(A,)], "rfc string"),
    }


def _decide(spark, books, scheme, cited, rfc=A):
    lead = spark.createDataFrame([("L", rfc, scheme, "r", "n")], LEAD)
    rows = spark.createDataFrame(
        [("L", rfc, i, kind, uuid, tx) for i, (kind, uuid, tx) in enumerate(cited)], EVIDENCE)
    resolved = evidence.resolve_evidence(rows, books["invoices"], books["ledger"])
    marked = evidence.mark_proofs(resolved, books["blacklist"], books["immaterial"], 5000)
    return evidence.verdicts(lead, marked, books["entities"], books["members"], 5000).first()


def bill(uuid):
    return ("factura", uuid, None)


def move(tx):
    return ("transferencia", None, tx)


@pytest.mark.parametrize("scheme,cited,rfc,rule,total", [
    ("EFOS_69B", [bill("f1")], A, "", "100.10"),
    (None, [bill("f1")], A, "CAMPOS_FALTANTES", "100.10"),
    ("EFOS_69B", [bill("f1")], "ZZZ010101ZZZ", "RFC_DESCONOCIDO", "0"),
    ("  ", [bill("f1")], A, "SIN_TIPIFICAR", "100.10"),
    ("LAVADO", [bill("f1")], A, "ESQUEMA_DESCONOCIDO", "100.10"),
    ("EFOS_69B", [], A, "SIN_EVIDENCIA", "0"),
    ("EFOS_69B", [move(None), ("factura", " ", None)], A, "SIN_EVIDENCIA", "0"),
    ("EFOS_69B", [bill("f1"), bill("nope")], A, "EVIDENCIA_INEXISTENTE", "100.10"),
    ("EFOS_69B", [bill("f1"), bill("f3")], A, "EVIDENCIA_AJENA", "100.10"),
    ("EFOS_69B", [bill("f0")], A, "MONTO_NO_POSITIVO", "0"),
    ("EFOS_69B", [bill("f2")], A, "SIN_PRUEBA_69B", "50"),
    ("EFOS_69B", [bill("f4")], A, "", "20"),                    # the accused may be the issuer
    ("KICKBACK_CIRCULAR", [move("t1")], A, "", "100.10"),
    ("KICKBACK_CIRCULAR", [move("t4")], B, "SIN_PRUEBA_CICLO", "5"),
    ("INGRESO_NO_DECLARADO", [move("t2")], A, "", "9000"),
    ("INGRESO_NO_DECLARADO", [move("t3")], A, "SIN_PRUEBA_INGRESO", "10"),
    ("INGRESO_NO_DECLARADO", [move("t2")], C, "SIN_PRUEBA_INGRESO", "9000"),
    ("SIN_MATERIALIDAD", [bill("f2")], A, "", "50"),
    ("EMPRESA_FACHADA", [bill("f1")], A, "SIN_PRUEBA_MATERIALIDAD", "100.10"),
    ("EFOS_69B", [bill("f1"), move("t1")], A, "", "100.10"),    # the same money once
    ("EFOS_69B", [bill("f1"), bill("f1")], A, "", "200.20"),    # a repeated citation adds twice
    ("EFOS_69B", [(None, "f1", None), (None, None, "t2")], A, "", "9100.10"),
])
def test_first_failing_rule_decides(spark, books, scheme, cited, rfc, rule, total):
    row = _decide(spark, books, scheme, cited, rfc)
    assert row["regla_fallida"] == rule
    assert row["monto_total_evidencia"] == Decimal(total)
    assert row["confirmado"] is (rule == "")
    if rule:
        assert row["razon"].startswith("DESCARTADO_FALTA_EVIDENCIA: ")


def test_the_first_bad_item_is_named(spark, books):
    row = _decide(spark, books, "EFOS_69B", [bill("f1"), bill("zz"), bill("aa")])
    assert "'zz'" in row["razon"]


def test_no_leads(spark, books):
    none = spark.createDataFrame([], EVIDENCE)
    resolved = evidence.resolve_evidence(none, books["invoices"], books["ledger"])
    marked = evidence.mark_proofs(resolved, books["blacklist"], books["immaterial"], 5000)
    assert evidence.verdicts(spark.createDataFrame([], LEAD), marked, books["entities"],
                             books["members"], 5000).count() == 0


def test_unseen_citations_are_dropped(spark):
    lead = spark.createDataFrame(
        [("1", A, "EFOS_69B", "r", "n"), ("2", A, "EFOS_69B", "r", "n"),
         ("3", A, "EFOS_69B", "r", "n")], LEAD)
    rows = spark.createDataFrame(
        [("1", A, 0, "factura", "f1", None), ("1", A, 1, "factura", "bad", None),
         ("2", A, 0, "factura", "bad", None)], EVIDENCE)
    seen = spark.createDataFrame([("f1",)], "id string")
    fixed, kept = leads.drop_unseen(lead, rows, seen)
    got = {r["lead_id"]: r for r in fixed.collect()}
    assert [r["uuid"] for r in kept.collect()] == ["f1"]
    assert got["1"]["tipo_esquema"] == "EFOS_69B" and got["3"]["narrativa"] == "n"
    assert got["2"]["tipo_esquema"] == "SIN_MATERIALIDAD" and "bad" in got["2"]["narrativa"]


def test_priority_of_schemes(spark):
    proving = spark.createDataFrame(
        [(A, 5, "factura", "f1", None), (A, 2, "transferencia", None, "t1"),
         (B, 5, "factura", "f2", None)],
        "rfc string, prioridad int, tipo string, uuid string, tx_id string")
    ids = spark.createDataFrame([(A,), (B,), (C,)], "rfc string")
    proposed, cited = leads.propose_leads(ids, proving)
    assert {r["lead_id"]: r["tipo_esquema"] for r in proposed.collect()} == {
        A: "KICKBACK_CIRCULAR", B: "SIN_MATERIALIDAD", C: ""}
    assert {(r["lead_id"], r["uuid"], r["tx_id"]) for r in cited.collect()} == {
        (A, None, "t1"), (B, "f2", None)}
    assert Settings().max_leg_ratio == 1.3


def test_an_item_is_named_by_the_identifier_it_is_looked_up_by(spark, books):
    cited = [("L", A, 0, "transferencia", "f1", "t2"), ("L", A, 1, "factura", "f2", "t1"),
             ("L", A, 2, None, "f1", "t1"), ("L", A, 3, "transferencia", "f9", None),
             ("L", A, 4, "factura", None, "t1")]
    rows = evidence.resolve_evidence(spark.createDataFrame(cited, EVIDENCE), books["invoices"],
                                     books["ledger"]).collect()
    got = {r["pos"]: (r["tipo"], r["id"], r["existe"]) for r in rows}
    assert got == {0: ("transferencia", "t2", True), 1: ("factura", "f2", True),
                   2: ("factura", "f1", True), 3: ("transferencia", "f9", False),
                   4: ("factura", "t1", False)}


def test_packed_folios_are_equal_where_folios_are(spark):
    texts = ["0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", "0A1B2C3D-0A1B-0A1B-0A1B-0A1B2C3D4E5F",
             "0a1b2c3d-0A1B-0a1b-0a1b-0a1b2c3d4e5f", "0" * 32, "uuid-ring0", "", "ñ" * 8,
             "01234567-0123-0123-0123-012345678901", "0a1b2c3d0a1b0a1b0a1b0a1b2c3d4e5f",
             " 0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f\n",
             "\x00" * 16, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn(
        "k", packed(F.col("t"))).select("t", "k", unpacked(F.col("k")).alias("back")).collect()
    assert all(r.back == r.t for r in rows)
    assert len({bytes(r.k) for r in rows if r.k is not None}) == len(texts) - 1
    assert len(rows[0].k) == 16 and rows[-1].k is None


def test_identifiers_under_the_wrong_column(spark):
    """An item is shown under the identifier it has, even where it is looked up by another."""
    invoices = spark.createDataFrame(
        [("i1", "A", "B", Decimal(5)), ("i1", "A", "C", Decimal(6))],
        "uuid string, emisor_rfc string, receptor_rfc string, total decimal(14,2)")
    ledger = spark.createDataFrame(
        [("t1", "B", "A", Decimal(5), "i1"), ("t2", "B", "A", Decimal(1), "i9")],
        "tx_id string, cuenta_origen_rfc string, cuenta_destino_rfc string, "
        "monto decimal(14,2), cfdi_uuid string")
    cited = spark.createDataFrame(
        [("L", "B", 0, "factura", "i1", "t9"), ("L", "B", 1, "factura", "", "t1"),
         ("L", "B", 2, "transferencia", "i1", ""), ("L", "B", 3, None, None, "t1"),
         ("L", "B", 4, "otro", "", "t2"), ("L", "B", 5, "factura", " ", None),
         ("M", "B", 0, "transferencia", None, "t1")],
        "lead_id string, rfc_imputado string, pos long, tipo string, uuid string, tx_id string")
    got = evidence.resolve_evidence(cited, invoices, ledger).collect()
    assert sorted((r.lead_id, r.pos, r.id, r.uuid, r.tx_id, r.a_rfc, r.contado_en_total)
                  for r in got if r.existe) == [
        ("L", 0, "i1", "i1", None, "B", True), ("L", 0, "i1", "i1", None, "C", False),
        ("L", 3, "t1", None, "t1", "A", False), ("L", 4, "t2", None, "t2", "A", True),
        ("M", 0, "t1", None, "t1", "A", True)]
    assert sorted((r.pos, r.id, r.uuid, r.tx_id) for r in got if not r.existe) == [
        (1, "t1", "", None), (2, "i1", None, "")]
