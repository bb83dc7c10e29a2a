from datetime import timedelta
from decimal import Decimal

import pytest

from folioscope import schema
from folioscope.operators import cycles, detectors, report, thresholds, views
from folioscope.plans import batch
from folioscope.sources.archive import Archive
from folioscope.sources.warehouse import Warehouse, case_rows
from pyspark.sql import functions as F
from tests.scenario import (ADVISOR, DEPOSITED, LISTED, RING, TRUCKS, VICTIM, Scenario)


def _candidates(spark, scenario):
    t = scenario.tables(spark)
    cycle_floor, income_floor = thresholds.amount_thresholds(t["ledger"])
    found = cycles.money_cycles(views.money_network(t["ledger"]), cycle_floor, 8)
    rows = detectors.candidates(t["invoices"], t["items"], t["ledger"], t["blacklist"], found,
                                income_floor).collect()
    return {r["rfc"]: r["detectores"] for r in rows}


@pytest.mark.parametrize("scale", [1.0, 0.2, 0.05])
def test_the_same_frauds_are_nominated_at_any_scale(spark, scale):
    assert _candidates(spark, Scenario(scale)) == {
        VICTIM: ["D1", "D4"], TRUCKS: ["D4"], DEPOSITED: ["D5"],
        **{rfc: ["D3"] for rfc in RING}}


def test_clean_books_nominate_nobody(spark):
    assert _candidates(spark, Scenario(frauds=False)) == {}


def test_books_without_a_bank_do_not_nominate_for_unpaid_invoices(spark):
    assert _candidates(spark, Scenario(frauds=False, bank=False)) == {}


def test_an_unpaid_invoice_nominates_both_parties(spark):
    scenario = Scenario(frauds=False)
    scenario.ledger = scenario.ledger[1:]
    seller, buyer = scenario.invoices[0][1:3]
    assert _candidates(spark, scenario) == {seller: ["D2"], buyer: ["D2"]}


def test_whole_run(spark, tmp_path):
    source = tmp_path / "libros"
    source.mkdir()
    folder = Scenario().csv_folder(source)
    out = batch.run(spark, folder, str(tmp_path / "out"))
    verdicts = {r["rfc_imputado"]: r for r in out["findings"].verdicts.collect()}
    confirmed = {k: (v["tipo_esquema"], v["monto_total_evidencia"])
                 for k, v in verdicts.items() if v["confirmado"]}
    legs = [Decimal("805807.00"), Decimal("781632.79"), Decimal("757458.58")]
    assert confirmed == {
        VICTIM: ("EFOS_69B", Decimal("420000.55")),
        RING[0]: ("KICKBACK_CIRCULAR", legs[0] + legs[2]),
        RING[1]: ("KICKBACK_CIRCULAR", legs[0] + legs[1]),
        RING[2]: ("KICKBACK_CIRCULAR", legs[1] + legs[2]),
        DEPOSITED: ("INGRESO_NO_DECLARADO", Decimal("907986.00")),
        TRUCKS: ("SIN_MATERIALIDAD", Decimal("260000.00"))}
    assert not [k for k, v in verdicts.items() if not v["confirmado"]]
    assert {r["tabla"]: r["n"] for r in out["counts"].collect()}["invoices"] == 57
    assert out["summary"].first()["n_confirmados"] == 6

    lines = [r["texto"] for r in out["document"].orderBy(*report.LINE_ORDER).collect()]
    assert lines[0] == "# Expediente Forense de Fraude Fiscal"
    assert "- **Monto total acreditado:** $420,000.55" in lines
    assert any(line.startswith("### 1. ANI010101AA1 — Empresa") for line in lines)
    report.write_document(out["document"], str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).count() == len(lines)

    archive = Archive(spark, str(tmp_path / "out" / "archive"))
    assert archive.count() == 1 and out["archive_failure"] is None
    opened = archive.open(out["expediente_id"])
    assert opened["confirmados"].count() == 6 and opened["descartados"].count() == 0
    assert opened["lineas"].count() == len(lines)
    assert archive.listing().first()["archivo_origen"] == "libros"
    assert archive.open("none") is None and archive.delete("none") is False

    # A second load replaces the case data and keeps the list and the archive.
    second = tmp_path / "otros"
    second.mkdir()
    clean = Scenario(frauds=False)
    clean.blacklist = []
    again = batch.run(spark, clean.csv_folder(second), str(tmp_path / "out"), keep_archive=False)
    from folioscope.sources.warehouse import Warehouse
    store = Warehouse(spark, str(tmp_path / "out" / "books"))
    assert store.current_version() == 2 and store.table("invoices").count() == 50
    assert [r["rfc"] for r in store.table("blacklist_69b").collect()] == [LISTED]
    assert again["findings"].verdicts.count() == 0 and archive.count() == 1
    assert archive.delete(out["expediente_id"]) and archive.count() == 0


def _loaded(store, n):
    """A load of n invoices."""
    rows = store.spark.range(n).select(F.col("id").cast("string").alias("uuid"))
    for field in schema.CASE_TABLES["invoices"].fields:
        if field.name != "uuid":
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return {"invoices": rows}


def test_expiry_waits_for_readers(spark, tmp_path):
    store, now = Warehouse(spark, str(tmp_path / "books")), timedelta(0)
    assert store.expire() == []                                     # nothing was loaded
    store.replace(_loaded(store, 3))
    with store.reading() as version:
        old = store.table("invoices", version)
        store.replace(_loaded(store, 4))
        store.replace(_loaded(store, 5))
        assert store.expire() == []                                 # replaced just now
        assert store.expire(keep=2, unread=now) == []               # read, or among the newest
        assert store.expire(keep=1, unread=now) == [2]
        assert version == 1 and old.count() == 3
        with store.reading() as later:
            assert later == 3
    assert store.expire(keep=1, unread=now) == [1]
    assert store.versions() == [3] and store.table("invoices").count() == 5
    assert store.expire(keep=1, unread=now) == []
    with pytest.raises(ValueError):
        store.expire(keep=0)


def test_expiry_of_unfinished_loads_and_lost_readers(spark, tmp_path):
    store, now = Warehouse(spark, str(tmp_path / "books")), timedelta(0)
    store.replace(_loaded(store, 1))
    slow, lost = store.stage(_loaded(store, 2)), store.stage(_loaded(store, 3))
    assert (slow, lost) == (2, 3)
    assert store.expire(keep=1, unread=now) == []                   # they may still commit
    assert store.commit(slow) == 2 and store.table("invoices").count() == 2
    assert store.expire(keep=2, abandoned=now) == [lost]
    with pytest.raises(RuntimeError):
        store.commit(lost)
    assert store.current_version() == 2
    assert store.replace(_loaded(store, 4)) == 4                    # its number is not used again
    (tmp_path / "books" / "readers" / "1").mkdir(parents=True)
    (tmp_path / "books" / "readers" / "1" / "dead").touch()         # its driver was lost
    assert store.expire(keep=2, unread=now) == []
    assert store.expire(keep=2, unread=now, abandoned=now) == [1]


def test_a_bad_row_rejects_the_load_before_anything_is_written(spark, tmp_path):
    source = tmp_path / "libros"
    source.mkdir()
    scenario = Scenario()
    scenario.entities = [e for e in scenario.entities if e[0] != ADVISOR]
    with pytest.raises(batch.RejectedLoad) as error:
        batch.run(spark, scenario.csv_folder(source), str(tmp_path / "out"))
    assert {r["valor"] for r in error.value.violations.collect()} == {ADVISOR}
    assert not (tmp_path / "out").exists()


def test_money_trail(spark):
    found = batch.investigate(**Scenario().tables(spark))
    confirmed = found.verdicts.where("confirmado")
    edges, nodes = report.money_trail(confirmed, found.evidence, found.cycles,
                                      Scenario().tables(spark)["blacklist"])
    text = report.trail_text(edges, nodes)

    def drawn(rfc):
        rows = text.where(F.col("lead_id") == rfc).orderBy("parte", "grupo", "pos", "id").collect()
        return "\n".join(r["texto"] for r in rows)

    victim = drawn(VICTIM)
    assert victim.startswith("digraph rastro {") and victim.endswith("}")
    assert f'"{LISTED}" [label="{LISTED}\\n69-B DEFINITIVO"' in victim
    assert f'"{LISTED}" -> "{VICTIM}" [label="  CFDI  $300,000.00" color="#6E7A86"];' in victim
    ring = drawn(RING[0])
    assert ring.count("->") == 3 and ring.count("penwidth=2.0") == 1
    assert drawn("nobody") == ""


def test_the_number_of_partitions_does_not_matter(spark):
    t = Scenario().tables(spark)
    split = {k: df.repartition(5) for k, df in t.items()}
    key = lambda f: sorted(tuple(r) for r in f.verdicts.collect())
    assert key(batch.investigate(**t)) == key(batch.investigate(**split))


def test_a_batch_over_texts_alone(spark, tmp_path):
    def paper(folio, issuer, receiver, total, concept):
        filler = "Documento de prueba sin valor fiscal. " * 6
        return (f"Folio fiscal: {folio}\nDespacho Uno\nRFC emisor: {issuer}\n"
                f"RFC receptor: {receiver}\nFecha: 2024-03-05T10:00:00\nTotal: {total}\n"
                f"Descripción: {concept}\n{filler}")
    rows = [(1, paper("0a92940f-03bd-4202-a6cc-54bf9ce20701", "QLM170815T63", "WTB210404K8A",
                      "1,160.50", "Asesoria general")),
            (2, paper("0a92940f-03bd-4202-a6cc-54bf9ce20702", "WTB210404K8A", "NPD090630C47",
                      "99.00", "Asesoria general")), (3, "corto"), (4, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    out = batch.run(spark, None, str(tmp_path / "out"), texts=texts)
    counts = {r["tabla"]: r["n"] for r in out["counts"].collect()}
    assert counts["invoices"] == 2 and counts["entities"] == 4 and "bank_ledger" not in counts
    notes = {(r["nota"], r["origen"]) for r in out["translation"].collect()}
    assert {("SIN_TEXTO", "3"), ("SIN_TEXTO", "4"), ("AUDITADA", "1")} <= notes
    assert out["findings"].verdicts.count() == out["findings"].candidates.count()
    assert out["cases"].count() == out["findings"].verdicts.count()


def test_loads_that_run_at_once_claim_different_numbers(spark, tmp_path):
    first, second = (Warehouse(spark, str(tmp_path)) for _ in range(2))
    assert first._claimed() != second._claimed()


def test_a_total_of_a_trillion_is_stored(spark, tmp_path):
    verdict = spark.createDataFrame(
        [("A", "EFOS_69B", Decimal("1500000000000.00"), "CONFIRMADO_CON_PRUEBA", True, "x", "", "y")],
        "rfc_imputado string, tipo_esquema string, monto_total_evidencia decimal(24,2), "
        "estatus_dictamen string, confirmado boolean, narrativa string, razon string, "
        "regla_fiscal string")
    rows, _ = case_rows(verdict, spark.createDataFrame([("A",)], "rfc string"))
    store = Warehouse(spark, str(tmp_path))
    store.commit(store.stage({}))
    store.write_cases(rows)
    assert store.table("cases").first()["monto_total_evidencia"] == Decimal("1500000000000.00")


def test_drafts_of_others_are_judged(spark):
    t = Scenario().tables(spark)
    cited = t["invoices"].where(F.col("receptor_rfc") == VICTIM).where(
        F.col("emisor_rfc") == LISTED).select("uuid").first()["uuid"]
    body = ('{"rfc_imputado": "%s", "tipo_esquema": "EFOS_69B", "evidencia": [{"tipo": "factura", '
            '"uuid": "%s"}]}')
    texts = spark.createDataFrame(
        [("1", VICTIM, body % (VICTIM, cited)), ("2", VICTIM, body % (VICTIM, "inventado")),
         ("3", VICTIM, "sin objeto")], "lead_id string, rfc string, text string")
    seen = t["invoices"].select(F.col("uuid").alias("id"))
    catalog = spark.createDataFrame([], schema.SECTOR_CATALOG)
    verdicts, _ = batch.judge_drafts(texts, seen, t["entities"], t["blacklist"], t["invoices"],
                                     t["items"], t["ledger"], catalog)
    assert {r["lead_id"]: r["regla_fallida"] for r in verdicts.collect()} == {
        "1": "", "2": "SIN_EVIDENCIA", "3": "SIN_EVIDENCIA"}
