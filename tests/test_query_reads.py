"""What the registered queries and audits read, and how often."""

import datetime as dt

import pytest

from folioscope import schema
from folioscope.functions.folios import packed, unpacked
from folioscope.operators import audits, cycles, evidence, materiality, presence, views
from folioscope.session import settle
from folioscope.workload import books, queries
from pyspark.sql import functions as F

A, B = "AAA010101AAA", "BBB010101BBB"
DAY = dt.datetime(2024, 1, 1)
TABLES = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
    "events": "event_id long, user_id long, event_type string, ts timestamp, value double",
}


@pytest.fixture(scope="module")
def ring(spark, tmp_path_factory):
    """Three users who pay each other in a ring, and nothing else."""
    folder = str(tmp_path_factory.mktemp("ring"))
    rows = [(e, u, "purchase", DAY, 500.0) for e, u in ((1, 0), (3, 1), (2, 2))]
    for name, columns in TABLES.items():
        spark.createDataFrame(rows if name == "events" else [], columns).write.parquet(
            f"{folder}/{name}.parquet")
    return folder


def _users(spark):
    return {r["rfc"] for r in spark.range(3).select(books.user_id(F.col("id")).alias("rfc"))
            .collect()}


@pytest.mark.parametrize("name", ["e5_proof_cycle", "g2_cycle_of"])
def test_cycles_of_books_that_are_not_stored(spark, ring, monkeypatch, name):
    stored = []
    monkeypatch.setattr(books, "settle", lambda df: stored.append(df.columns) or settle(df))
    found = queries.queries()[name](spark, ring)
    assert {r["rfc"] for r in found.collect()} == _users(spark)
    assert stored == []


def test_proof_of_income_keeps_no_resolved_rows(spark, ring, monkeypatch):
    kept = []
    monkeypatch.setattr(queries, "settle", lambda df: kept.append(df.columns) or settle(df))
    found = queries.queries()["e7_proof_income"](spark, ring)
    expected = spark.createDataFrame([(1,), (2,), (3,)], "event_id long").select(
        books.folio("E", "event_id").alias("id"))
    assert {r["lead_id"] for r in found.collect()} == {r["id"] for r in expected.collect()}
    assert kept == []


def test_cited_transfers_are_kept_by_short_keys(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(evidence, "settle", lambda df: kept.append(df.columns) or settle(df))
    pays = "0123abcd-0000-4000-8000-0123456789ab"
    invoices = spark.createDataFrame([(pays, B, A, DAY, None, None, "PUE", "03", "VIGENTE")],
                                     schema.INVOICES)
    ledger = spark.createDataFrame(
        [("t1", A, B, DAY, None, None, pays), ("t2", A, B, DAY, None, None, None),
         ("t3", A, B, DAY, None, None, "")], schema.LEDGER)
    cited = spark.createDataFrame(
        [("L", A, 0, "factura", pays, None), ("L", A, 1, "transferencia", None, "t1"),
         ("L", A, 2, "transferencia", None, "t2"), ("L", A, 3, "transferencia", "t3", "t3"),
         ("L", A, 4, "transferencia", "x", ""), ("M", A, 0, "transferencia", None, "t1")],
        "lead_id string, rfc_imputado string, pos long, tipo string, uuid string, tx_id string")
    rows = evidence.resolve_evidence(cited, invoices, ledger).orderBy("lead_id", "pos").collect()
    assert [(r["lead_id"], r["id"], r["tx_id"], r["cfdi_uuid"], r["contado_en_total"])
            for r in rows] == [
        ("L", pays, None, None, True), ("L", "t1", "t1", pays, False),
        ("L", "t2", "t2", None, True), ("L", "t3", "t3", "", True),
        ("L", "x", "", None, False), ("M", "t1", "t1", pays, True)]
    assert not any({"id", "tx_id", "cfdi_uuid"} & set(columns) for columns in kept)


def test_list_status_reads_the_texts_once(spark, tmp_path):
    spark.createDataFrame(
        [("r", f"{A.lower()} es solo presunto"), ("r", f"Vea {A}."), ("w", f"{A.lower()} presunto"),
         (None, f"{A} presunto"), ("x", f"{A} es presunto, {A}")],
        "answer_id string, text string").write.parquet(f"{tmp_path}/texts")
    listed = spark.createDataFrame([(A, "DEFINITIVO", None, None)], schema.BLACKLIST)
    found = audits.wrong_list_status(spark.read.parquet(f"{tmp_path}/texts"), listed)
    assert sorted(r["answer_id"] for r in found.collect()) == ["r", "x"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [answer_id") == 1


def test_confirmed_ids_are_worked_out_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(audits, "settle", lambda df: kept.append(df.columns) or settle(df))
    texts = spark.createDataFrame([("1", f"No se imputo a {A}.")], "answer_id string, text string")
    cases = spark.createDataFrame([(A,)], "rfc_imputado string")
    assert audits.denied_cases(texts, cases).count() == 1
    assert kept == [["rfc_imputado"]]


def test_stored_books_are_kept_by_keys_and_joined_once(spark, tmp_path, monkeypatch):
    when = DAY.replace(day=2)
    rows = {"lineitem": [(1, 5, 7, 1, 10.0, 100.0, 0.1, 0.08, "R", "F", when),
                         (1, 6, 7, 2, 50.0, 30.0, 0.0, 0.0, "N", "O", when),
                         (2, 5, 8, 1, 49.0, 20.0, 0.0, 0.0, "A", "F", when),
                         (3, 5, 8, 1, 49.0, None, 0.0, 0.0, None, "F", None),
                         (None, 5, 8, 1, 1.0, 1.0, 0.0, 0.0, "N", "F", when)],
            "orders": [(1, 3, "F", 40000.0, DAY, "1-URGENT"), (2, 4, "O", 10.0, DAY, "5-LOW"),
                       (3, 4, "P", None, DAY, None)]}
    rows["lineitem"], rows["orders"] = rows["lineitem"] + rows["lineitem"][:1], rows["orders"] * 2
    for name, columns in TABLES.items():
        spark.createDataFrame(rows.get(name, []), columns).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = []
    monkeypatch.setattr(books, "settle", lambda df: kept.append(df.columns) or settle(df))
    read, stored = (books.Books(spark, str(tmp_path), s) for s in (False, True))
    for name in ("ledger", "evidence", "invoices", "leads"):
        assert (sorted(map(str, getattr(stored, name).collect()))
                == sorted(map(str, getattr(read, name).collect())))
    assert [r["total"] for r in read.invoices.where("uuid is not null").collect()].count(230) == 2
    assert len(kept) == 2                       # the lines with their orders, and the invoices
    texts = {"uuid", "tx_id", "cfdi_uuid", "emisor_rfc", "rfc_imputado", "cuenta_origen_rfc"}
    assert not any(texts & set(columns) for columns in kept)


def test_cited_rows_are_written_before_they_are_looked_up(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(evidence, "settle", lambda df: kept.append(df.columns) or settle(df))
    cited = spark.createDataFrame(
        [("L", A, 0, None, "x", None)],
        "lead_id string, rfc_imputado string, pos long, tipo string, uuid string, tx_id string")
    nothing = spark.createDataFrame([], schema.INVOICES), spark.createDataFrame([], schema.LEDGER)
    rows = evidence.resolve_evidence(cited, *nothing).collect()
    assert [(r["id"], r["uuid"], r["existe"]) for r in rows] == [("x", "x", False)]
    assert kept[0] == ["lead_id", "rfc_imputado", "pos", "tipo", "_key", "_else"]


def test_kept_evidence_says_nothing_twice(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(evidence, "settle", lambda df: kept.append(df) or settle(df))
    columns = ("lead_id string, rfc_imputado string, pos long, tipo string, id string, "
               "uuid string, tx_id string, de_rfc string, a_rfc string")
    rows = [("L", A, 0, "factura", "u", "u", None, A, B), ("L", A, 1, "factura", "t", None, None, B, A),
            ("L", A, 2, "transferencia", "t", None, "t", None, None),
            ("L", A, 3, "transferencia", "u", None, "", B, B),
            ("M", None, 0, "factura", "u", "u", None, None, A)]
    given = spark.createDataFrame(rows, columns)
    found = evidence.keep_resolved(given)
    assert found.columns == given.columns
    assert [tuple(r) for r in found.orderBy("lead_id", "pos").collect()] == rows
    written = kept[0].orderBy("lead_id", "pos").select("id", "de_rfc", "a_rfc").collect()
    assert [tuple(r) for r in written] == [
        (None, None, B), ("t", B, None), (None, None, None), ("u", B, B), (None, None, A)]


def test_only_transfers_between_payers_are_summed_for_cycles(spark):
    moves = [(A, B), (B, A), (A, A), ("C", A), (A, "D"), (None, A), (B, None), (A, B)]
    ledger = spark.createDataFrame(
        [(str(i), a, b, DAY, None, None, None) for i, (a, b) in enumerate(moves)], schema.LEDGER)
    assert [r["tx_id"] for r in cycles.between_payers(ledger).orderBy("tx_id").collect()] == [
        "0", "1", "7"]


def test_invoices_are_not_moved_to_find_whose_history_is_needed(spark):
    invoices = spark.createDataFrame(
        [("i1", A, B, DAY, None, None, "PUE", "03", "VIGENTE"),
         ("i2", B, A, DAY, None, None, "PUE", "03", "VIGENTE")], schema.INVOICES)
    items = spark.createDataFrame([("i1", "acero", 1), ("i2", "nada", 2)],
                                  "invoice_uuid string, descripcion string, _row long")
    catalog = spark.createDataFrame([(B, "b", "g", ["acero", "acero"])],
                                    "rfc string, razon_social string, giro string, "
                                    "descripciones_esperadas array<string>")
    names = spark.createDataFrame([(A, "a")], "rfc string, razon_social string")
    seen = []
    drawn = materiality.key_map
    materiality.key_map = lambda keys, *c: seen.append(keys.columns) or drawn(keys, *c)
    try:
        heads, texts = materiality.profiles(
            spark.createDataFrame([(A,), (B,)], "rfc string"), catalog, invoices, items, names)
    finally:
        materiality.key_map = drawn
    assert sorted((r["rfc"], r["fuente"]) for r in heads.collect()) == [
        (A, "HISTORIAL"), (B, "CATALOGO")]
    assert sorted(map(tuple, texts.collect())) == [(A, "acero"), (B, "acero")]
    assert seen == [["rfc"]]


def test_amounts_are_sought_around_confirmed_ids_only(spark, monkeypatch):
    drawn = []
    key_map = audits.key_map
    monkeypatch.setattr(audits, "key_map", lambda keys, *c: drawn.append(keys) or key_map(keys, *c))
    texts = spark.createDataFrame(
        [("1", f"{A} suma $5.00 y {B} suma $7.00"), ("2", f"CCC010101CCC suma $7.00"), (None, None)],
        "answer_id string, text string")
    amounts = spark.createDataFrame([(A, 5), (B, 7)], "rfc string, monto int").withColumn(
        "monto", F.col("monto").cast("decimal(24,2)"))
    found = audits.swapped_amounts(texts, amounts).collect()
    assert sorted((r["answer_id"], r["rfc"], r["dueno"]) for r in found) == [
        ("1", A, B), ("1", B, A)]
    assert [sorted(r["rfc"] for r in keys.collect()) for keys in drawn] == [[A, B]]


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line for line in plan if "Filter" in line]


def test_identifiers_are_not_made_again_to_filter_by_them(spark, ring, monkeypatch):
    b = books.Books(spark, ring, stored=True)
    kept = []
    monkeypatch.setattr(evidence, "settle", lambda df: kept.append(df) or settle(df))
    resolved = evidence.resolve_evidence(b.evidence, b.invoices, b.ledger)
    network = views.money_network(cycles.between_payers(b.ledger))
    monkeypatch.setattr(cycles, "settle", lambda df: kept.append(df) or settle(df))
    search = cycles.CycleSearch(network, 1.0, 4)
    assert {r["rfc"] for r in search.members().collect()} == _users(spark)
    assert len(kept) > 4
    assert not [line for df in kept + [resolved, network] for line in _filters(df) if "md5(" in line]


def test_a_key_is_null_only_where_its_folio_is(spark):
    texts = ["0123abcd-0000-4000-8000-0123456789ab", "0123ABCD-0000-4000-8000-0123456789AB",
             "0123abcd-0000-4000-8000-0123456789aB", "", "ñ", "0123abcd000040008000-0123456789ab"]
    given = spark.createDataFrame([(t,) for t in texts + [None]], "t string")
    both = given.select("t", packed(F.col("t")).alias("k")).select("t", "k", unpacked(F.col("k")).alias("u"))
    assert [r["u"] for r in both.collect()] == texts + [None]
    assert [len(r["k"]) for r in both.where("t is not null").collect()] == [16, 17, 54, 18, 20, 51]
    sure = spark.range(1).select(packed(F.concat_ws("-", F.lit("a"), "id")).alias("k"))
    assert not sure.schema["k"].nullable


def test_rows_without_an_identifier_are_not_looked_up(spark):
    cited = spark.createDataFrame(
        [("L", A, 0, "factura", " ", "t"), ("L", A, 1, "transferencia", "u", "  "),
         ("L", A, 2, None, None, None), ("L", A, 3, "factura", "", "t"), ("L", A, 4, None, "", "t")],
        "lead_id string, rfc_imputado string, pos long, tipo string, uuid string, tx_id string")
    nothing = spark.createDataFrame([], schema.INVOICES), spark.createDataFrame([], schema.LEDGER)
    rows = evidence.resolve_evidence(cited, *nothing).orderBy("pos").collect()
    assert [(r["pos"], r["tipo"], r["id"]) for r in rows] == [
        (3, "factura", "t"), (4, "transferencia", "t")]


def test_the_map_is_kept_as_whole_numbers(spark):
    drawn = presence.key_map(spark.range(3000), F.col("id"))
    assert dict(drawn.dtypes) == {"_bucket": "bigint", "_words": "array<bigint>"}
    assert {len(r["_words"]) for r in drawn.collect()} == {512}
    marked = presence.among(spark.range(6000), drawn, "m", F.col("id"))
    assert marked.where("m and id < 3000").count() == 3000
    assert marked.where("m and id >= 3000").count() < 10
