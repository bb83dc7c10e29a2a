from decimal import Decimal

from folioscope import schema
from folioscope.functions.text import fold, header_name
from folioscope.operators import materiality
from pyspark.sql import functions as F
from tests.scenario import ADVISOR, TRUCKS, Scenario, VAGUE


def test_fold(spark):
    cases = {"Consultoría ESTRATÉGICA": "consultoria estrategica", "Ñandú": "nandu",
             "éa": "ea", "ﬁn ½ ĳ": "fin 1⁄2 ij", "plain": "plain", "ŁÓDŹ": "łodz"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", fold(F.col("t")))
    assert {r[0]: r[1] for r in df.collect()} == cases
    row = spark.range(1).select(header_name(F.lit("C.P. del Domicilió #1"))).first()
    assert row[0] == "cpdeldomicilio1"


def _verdicts(spark, catalog_rows=()):
    t = Scenario().tables(spark)
    catalog = spark.createDataFrame(list(catalog_rows), schema.SECTOR_CATALOG)
    received = materiality.received_concepts(t["invoices"], t["items"])
    pairs = received.select("rfc", "concepto").distinct()
    heads, texts = materiality.profiles(pairs, catalog, t["invoices"], t["items"], t["entities"])
    verdicts = materiality.concept_verdicts(pairs, heads, texts)
    by_invoice = materiality.invoice_verdicts(t["invoices"], received, verdicts)
    words = materiality.profile_words(texts)
    failing = materiality.failing_concepts(pairs, heads, words)
    return ({(r["rfc"], r["concepto"]): r for r in verdicts.collect()},
            {r["uuid"]: r for r in by_invoice.collect()},
            {tuple(r) for r in failing.collect()})


def test_generic_concept_foreign_to_the_history_fails(spark):
    concepts, invoices, failing = _verdicts(spark)
    assert concepts[(TRUCKS, VAGUE)]["match"] is False
    assert "Flete" in concepts[(TRUCKS, VAGUE)]["motivo"]
    assert invoices["uuid-vague"]["match"] is False
    assert failing == {(r, c) for (r, c), v in concepts.items() if v["match"] is False}
    # No history and no catalog: nothing to compare with.
    assert concepts[("VIC010101AA1", "Servicios profesionales diversos")]["match"] is None


def test_declared_catalog_comes_first(spark):
    catalog = [(TRUCKS, "Fletes", "consultoria", [], ["Consultoría fiscal"])]
    concepts, _, failing = _verdicts(spark, catalog)
    assert concepts[(TRUCKS, VAGUE)]["match"] is True and not failing


def test_words_match_inside_words_and_first_failing_item_decides(spark):
    items = spark.createDataFrame(
        [("f", "1", "Transportes y gestion", Decimal(1), Decimal(1), Decimal(1), 0),
         ("f", "1", "gestion", Decimal(1), Decimal(1), Decimal(1), 1),
         ("own", "1", "transporte general", Decimal(1), Decimal(1), Decimal(1), 2)], schema.ITEMS)
    t = Scenario().tables(spark)
    bills = t["invoices"].limit(1)
    rows = [(u, e, r) for u, e, r in [("f", ADVISOR, TRUCKS), ("own", TRUCKS, ADVISOR),
                                      ("bare", ADVISOR, TRUCKS)]]
    names = spark.createDataFrame(rows, "uuid string, emisor_rfc string, receptor_rfc string")
    invoices = names.join(bills.drop("uuid", "emisor_rfc", "receptor_rfc"), how="cross")
    received = materiality.received_concepts(invoices, items)
    pairs = received.select("rfc", "concepto").distinct()
    heads, texts = materiality.profiles(pairs, t["catalog"], invoices, items, t["entities"])
    verdicts = materiality.concept_verdicts(pairs, heads, texts)
    got = {r["concepto"]: r["match"] for r in verdicts.where(f"rfc = '{TRUCKS}'").collect()}
    assert got == {"Transportes y gestion": True, "gestion": False}
    by = {r["uuid"]: r for r in materiality.invoice_verdicts(
        invoices, received, verdicts).collect()}
    assert by["f"]["concepto"] == "gestion" and by["f"]["match"] is False
    assert by["bare"]["match"] is None and "ninguna partida" in by["bare"]["motivo"]


def test_an_invoice_verdict_without_reasons_shuffles_no_sentence(spark):
    t = Scenario().tables(spark)
    received = materiality.received_concepts(t["invoices"], t["items"])
    pairs = received.select("rfc", "concepto").distinct()
    heads, texts = materiality.profiles(pairs, t["catalog"], t["invoices"], t["items"],
                                        t["entities"])
    verdicts = materiality.concept_verdicts(pairs, heads, texts)
    full = materiality.invoice_verdicts(t["invoices"], received, verdicts)
    bare = materiality.invoice_verdicts(t["invoices"], received, verdicts, reasons=False)
    assert sorted(map(tuple, bare.collect()), key=str) == sorted(
        map(tuple, full.drop("motivo").collect()), key=str)
    plan = bare._jdf.queryExecution().optimizedPlan().toString()
    assert "ajeno al giro" not in plan
