import datetime as dt
from decimal import Decimal

import pytest

from folioscope import schema
from folioscope.operators import integrity, similarity, sqlgate
from folioscope.sources import (canonical, documents, drafts, foreign, official_list, staging)
from folioscope.sources.staging import LoadError
from pyspark.sql import functions as F
from tests.scenario import Scenario

FULL = {
    "Entidades": ("rfc", "razon_social", "fecha_constitucion", "representante_legal",
                  "codigo_postal", "es_empresa_auditada"),
}


def _entities(spark, *rows):
    schema_text = ", ".join(f"{c} string" for c in FULL["Entidades"]) + ", _row long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema_text)


def test_missing_tables_and_columns_are_all_named(spark, tmp_path):
    with pytest.raises(LoadError, match="Facturas.*Partidas"):
        staging.require_tables({"Entidades": None, "Lista_69B": None})
    with pytest.raises(LoadError, match="razon_social.*codigo_postal"):
        staging.require_columns(spark.createDataFrame([], "rfc string"), "Entidades")
    with pytest.raises(FileNotFoundError):
        staging.read_folder(spark, str(tmp_path / "none"))


def test_rows_keep_their_place_across_files_and_blocks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i},x\n" for i in range(20000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = staging.read_text_table(spark, str(path), "csv")
        assert df.rdd.getNumPartitions() > 1
        assert df.where("cast(a as long) <> _row").count() == 0 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_entities_are_typed_and_faults_name_the_source_row(spark):
    raw = _entities(
        spark, (" AAA ", "Uno ", None, None, "640", None), ("BBB", "Dos", "12/05/2011", " R ",
                                                            "123456", "Sí"),
        ("CCC", None, "2011-05-12", None, "64000", "0"), ("DDD", "Cuatro", "ayer", None, "1", "2"),
        ("EEE", "Cinco", None, None, "9", "nan"))
    rows, faults = canonical.typed_table("Entidades", raw)
    got = {r["rfc"]: r for r in rows.collect()}
    assert set(got) == {"AAA", "BBB", "EEE"}
    assert got["AAA"]["codigo_postal"] == "00640" and got["BBB"]["codigo_postal"] == "12345"
    assert got["BBB"]["fecha_constitucion"] == dt.date(2011, 5, 12)
    assert got["BBB"]["es_empresa_auditada"] and not got["AAA"]["es_empresa_auditada"]
    assert not got["EEE"]["es_empresa_auditada"]
    assert {(r["fila"], r["columna"], r["regla"]) for r in faults.collect()} == {
        (4, "razon_social", "VALOR_NULO"), (5, "fecha_constitucion", "FECHA_INVALIDA")}


def test_empty_blacklist_is_allowed(spark):
    rows, faults = canonical.typed_table("Lista_69B", spark.createDataFrame([], "x string"))
    assert rows.count() == 0 and faults.count() == 0


def test_last_row_wins_and_later_load_wins(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)],
                                 "k string, v int, _row long")
    assert {tuple(r) for r in canonical.last_row_wins(rows, "k").collect()} == {("a", 3), ("b", 2)}
    day, zero = dt.date(2024, 1, 1), Decimal(0)
    stored = spark.createDataFrame([("a", "PRESUNTO", day, zero), ("b", "PRESUNTO", day, zero)],
                                   schema.BLACKLIST)
    new = spark.createDataFrame([("a", "DEFINITIVO", day, zero, 0)],
                                "rfc string, situacion string, publicacion_dof date, "
                                "monto_presunto_total decimal(14,2), _row long")
    merged = canonical.merged_blacklist(stored, new).collect()
    assert {(r["rfc"], r["situacion"]) for r in merged} == {("a", "DEFINITIVO"), ("b", "PRESUNTO")}


def test_orphans_are_counted(spark):
    t = Scenario().tables(spark)
    found = integrity.reference_violations({
        "entities": t["entities"].where("rfc <> 'EFO010101AA1'"), "invoices": t["invoices"],
        "invoice_items": t["items"], "bank_ledger": t["ledger"]}).collect()
    assert {(r["tabla"], r["columna"], r["n"]) for r in found} == {
        ("invoices", "emisor_rfc", 2), ("bank_ledger", "cuenta_destino_rfc", 2)}


def test_official_lists(spark, tmp_path):
    path = tmp_path / "Definitivos.csv"
    good = '1,AAA010101AAA,"Uno, S.A. Ñandú",Definitivo' + "," * 12 + "5/03/2024"
    lines = ["preambulo", "legal, largo", "tres", "No,RFC,Nombre,Situación", good,
             "2,BBB010101BBB,Dos,Sentencia Favorable" + "," * 12 + "05/03/2024",
             "3,,Tres,Definitivo" + "," * 12 + "05/03/2024",
             "4,CCC010101CCC,Cuatro,Definitivo" + "," * 12 + "pronto", "5,DDD010101DDD,Corta,Definitivo"]
    path.write_bytes("\n".join(lines).encode("latin-1"))
    first = official_list.parse_official_list(
        official_list.read_raw_list(spark, str(path)), "Definitivo", "DEFINITIVO", 15)
    assert [tuple(r) for r in first.collect()] == [
        ("AAA010101AAA", "Uno, S.A. Ñandú", "DEFINITIVO", dt.date(2024, 3, 5))]
    later = first.withColumn("situacion", F.lit("PRESUNTO"))
    assert official_list.merge_lists([first, later]).first()["situacion"] == "PRESUNTO"
    assert official_list.recent_final(official_list.merge_lists([first])).count() == 1


def test_foreign_names(spark):
    raw = spark.createDataFrame([("AAA010101AAA", "Prueba SA", "64000")],
                                ["Clave RFC", "Denominacion o Razon Social", "C.P. del Domicilio"])
    tables, report = foreign.translate(spark, {"Catalogo de Clientes": raw})
    row = tables["Entidades"].first()
    assert row["es_empresa_auditada"] is None and row["rfc"] is None
    assert report.where("destino = 'es_empresa_auditada'").count() == 1
    assert foreign.canonical_table("detalle de facturas 2024") == "Facturas"
    assert foreign.canonical_table("Bancos") == "Transacciones_Bancarias"
    assert foreign.canonical_table("Hoja1") is None
    assert foreign.infer_table(["Folio Fiscal", "RFC Emisor", "RFC Receptor", "Fecha"]) == "Facturas"
    assert foreign.infer_table(["a", "b", "rfc"]) is None
    mapping, rest = foreign.canonical_columns(["Concepto", "Referencia", "Otra"],
                                              "Transacciones_Bancarias")
    assert mapping == {"Concepto": "referencia_bancaria"} and rest == ["Referencia", "Otra"]


TEXT = """Despacho Contable del Norte
Direccion:
ADR531130N5A
Folio 0a92940f-03bd-4202-a6cc-54bf9ce20747 2024-05-06T07:08:09
Receptor XAXX010101004
Núm. Empleado: 001 - Juan Pérez
Subtotal: 1,000.00
Total Percepciones: 9.00
Total: 1,160.50
Método de pago: PUE Forma de pago 03
Descripción: Nómina de mayo
Lugar de expedición: 64000
R.F.C. Proveedor: SAT970701NN3
Cadena Original ||1.1|SAT970701NN3|Total: 5.00|BBB010101BBB||"""


def test_invoice_fields_from_text(spark):
    docs = spark.createDataFrame(
        [(1, TEXT), (2, "Total: 0.00 ADR531130N5A"), (3, "")], "doc_id long, text string")
    fields = documents.extract_invoice_fields(docs)
    row = fields.where("doc_id = 1").first()
    assert (row["emisor_rfc"], row["receptor_rfc"], row["rfc_pac"]) == (
        "ADR531130N5A", "XAXX010101004", "SAT970701NN3")
    assert (row["subtotal"], row["total"]) == (Decimal("1000.00"), Decimal("1160.50"))
    assert row["razon_social_emisor"] == "Despacho Contable del Norte"
    assert row["razon_social_receptor"] == "Juan Pérez"
    assert (row["metodo_pago"], row["forma_pago"], row["cp_emisor"]) == ("PUE", "03", "64000")
    rows = documents.invoice_rows(fields)
    assert rows["Entidades"].count() == 2 and rows["Facturas"].count() == 1
    item = rows["Partidas"].first()
    assert item["descripcion"] == "Nómina de mayo" and item["importe"] == Decimal("1160.50")
    rejected = {r["doc_id"]: r["faltantes"] for r in rows["rechazados"].collect()}
    assert rejected == {2: "uuid, receptor_rfc, total",
                        3: "uuid, emisor_rfc, receptor_rfc, total"}
    known = spark.createDataFrame([("ADR531130N5A",)], "rfc string")
    screened = similarity.screen_read_ids(
        spark.createDataFrame([("ADR531130N5A",), ("XAXX010101004",)], "rfc string"), known)
    assert documents.review_parties(fields, screened).where("confiable").count() == 2
    routes = documents.route_documents(docs)
    assert {r["doc_id"]: r["ruta"] for r in routes.collect()} == {
        1: "TEXTO", 2: "NECESITA_OCR", 3: "NECESITA_OCR"}


def test_drafts(spark):
    body = '{"rfc_imputado": "A", "tipo_esquema": "EFOS_69B", "evidencia": [{"uuid": "f"}]}'
    texts = spark.createDataFrame(
        [("1", "A", body), ("2", "A", f"```json\n{body}\n```"), ("3", "A", f"Es: {body} fin"),
         ("4", "A", "nada"), ("5", "A", "{roto")], "lead_id string, rfc string, text string")
    got = {r["lead_id"]: r for r in drafts.parse_drafts(texts).collect()}
    for i in "123":
        assert got[i]["tipo_esquema"] == "EFOS_69B" and got[i]["evidencia"][0]["uuid"] == "f"
    for i in "45":
        assert got[i]["tipo_esquema"] == "SIN_MATERIALIDAD" and got[i]["evidencia"] == []
        assert got[i]["rfc_imputado"] == "A"
    assert drafts.read_sector_catalog(spark, None).count() == 0


def test_sector_catalog_is_one_map(spark, tmp_path):
    path = tmp_path / "giros.json"
    path.write_text('{"AAA010101AAA": {"razon_social": "Uno", "giro": "obra", "claves_esperadas":'
                    ' ["01"],\n "descripciones_esperadas": ["muros"]}, "BBB010101BBB": {}}')
    got = {r["rfc"]: r for r in drafts.read_sector_catalog(spark, str(path)).collect()}
    assert got["AAA010101AAA"]["descripciones_esperadas"] == ["muros"]
    assert got["BBB010101BBB"]["giro"] is None and len(got) == 2


def test_the_later_row_of_a_list_wins(spark, tmp_path):
    path = tmp_path / "lista.csv"
    row = "1,AAA010101AAA,{},Definitivo" + "," * 12 + "{}"
    path.write_bytes("\n".join([row.format("Nueva", "05/03/2024"),
                                row.format("Vieja", "01/02/2020")]).encode("latin-1"))
    raw = official_list.read_raw_list(spark, str(path))
    found = official_list.parse_official_list(raw, "Definitivo", "DEFINITIVO", 15, "_row")
    merged = official_list.merge_lists([found])
    assert merged.first()["razon_social"] == "Vieja"
    official_list.write_lists(merged, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/catalogo"), header=True).count() == 1
    assert spark.read.csv(str(tmp_path / "out/recientes"), header=True).count() == 0


@pytest.mark.parametrize("sql", [
    "DELETE FROM invoices", "SELECT 1; DROP TABLE invoices", "UPDATE entities SET rfc = 'x'",
    "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT 1 FROM a WHERE x = 'drop'", ""])
def test_only_one_plain_select(sql):
    with pytest.raises(sqlgate.QueryNotAllowed):
        sqlgate.checked(sql)


def test_select_runs_over_the_named_tables(spark):
    t = Scenario().tables(spark)
    sqlgate.register({"entities": t["entities"], "invoices": t["invoices"],
                      "invoice_items": t["items"], "bank_ledger": t["ledger"]})
    assert sqlgate.query(spark, " select count(*) n from v_money_network; ").first()["n"] > 0
