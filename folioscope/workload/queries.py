"""The registered queries: every operator over the whole benchmark books.

Each returns flat columns (money as double, dates as text, arrays joined), so the
result can be compared with `oracles.py` value by value.
"""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import fixed_values as fv
from folioscope.functions import parsing, taxid, text
from folioscope.operators import (audits, blacklist, cycles, detectors, evidence, integrity, leads,
                                  materiality, ranking, report, similarity, sqlgate, thresholds,
                                  views)
from folioscope.plans import batch
from folioscope.session import settle, shared_folder
from folioscope.sources import (archive, canonical, documents, drafts, foreign, official_list,
                                staging, warehouse)
from folioscope.workload.books import SETTINGS, Books, customer_id, folio, money, supplier_id
from folioscope.workload.books import taxid as hashed_taxid

_QUERIES = {}


def _registered(name: str, stored: bool = False):
    def keep(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(build(Books(spark, sf_dir, stored)))
        _QUERIES[name] = query
        return build
    return keep


def queries() -> dict:
    return dict(_QUERIES)


def flat(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- staging text derived from the tables --------------------------------------

def _text_tables(b: Books) -> dict[str, DataFrame]:
    """Unclean text versions of the five input tables."""
    none = F.lit(None).cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text_money = lambda c: money(c).cast("string")
    order_id = F.col("o_orderkey").cast("string")
    return {
        "Entidades": b.raw("customer").select(
            F.concat(F.lit("  "), customer_id("c_custkey"), F.lit(" ")).alias("rfc"),
            F.when(F.col("c_acctbal") >= -900, F.col("c_name")).alias("razon_social"),
            F.when(F.col("c_mktsegment") == "BUILDING", "12/05/2011")
            .when(F.col("c_mktsegment") == "MACHINERY", "2011-05-12")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "mayo").alias("fecha_constitucion"),
            F.when(F.col("c_acctbal") > 0, F.concat(F.col("c_mktsegment"), F.lit(" ")))
            .alias("representante_legal"),
            F.col("c_nationkey").cast("string").alias("codigo_postal"),
            F.when(F.col("c_nationkey") < 5, "Sí").when(F.col("c_nationkey") < 10, "0")
            .when(F.col("c_nationkey") < 15, "2.5").when(F.col("c_nationkey") < 20, "no")
            .alias("es_empresa_auditada"),
            F.col("c_custkey").alias("_row")),
        "Lista_69B": b.raw("supplier").select(
            supplier_id("s_suppkey").alias("rfc"),
            F.when(F.col("s_acctbal") < 0, " definitivo").when(F.col("s_acctbal") < 5000, "Presunto")
            .when(F.col("s_acctbal") < 9000, "DESVIRTUADO").otherwise("otro").alias("situacion"),
            F.when(F.col("s_nationkey") < 20, "2024-03-01").alias("publicacion_dof"),
            F.when(F.col("s_acctbal") > 1000, text_money("s_acctbal"))
            .alias("monto_presunto_total"),
            F.col("s_suppkey").alias("_row")),
        "Facturas": b.raw("orders").select(
            folio("O", "o_orderkey").alias("uuid"), customer_id("o_custkey").alias("emisor_rfc"),
            customer_id("o_custkey").alias("receptor_rfc"),
            F.when(status == "F", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
            .when(status == "O", F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(F.col("o_totalprice") > 20000, F.date_format("o_orderdate", "yyyy/MM/dd"))
            .alias("fecha_emision"),
            text_money("o_totalprice").alias("subtotal"),
            F.when(F.col("o_totalprice") > 10000, text_money("o_totalprice")).otherwise("n/d")
            .alias("total"),
            F.when(priority == "1-URGENT", " pue").when(priority == "2-HIGH", "PPD")
            .when(priority == "3-MEDIUM", "ppd ").when(F.col("o_totalprice") > 15000, "PUE")
            .alias("metodo_pago"),
            F.when(F.col("o_totalprice") > 12000, "03").alias("forma_pago"),
            F.when(status == "F", "vigente").when(status == "O", "cancelado ")
            .alias("estado_cfdi"), F.col("o_orderkey").alias("_row")),
        "Partidas": b.raw("lineitem").select(
            folio("O", "l_orderkey").alias("invoice_uuid"),
            F.col("l_partkey").cast("string").alias("clave_prod_serv"),
            F.concat_ws(" ", F.lit(" parte"), "l_returnflag", "l_linestatus")
            .alias("descripcion"),
            F.col("l_quantity").cast("decimal(10,2)").cast("string").alias("cantidad"),
            F.when(F.col("l_extendedprice") > 1000, text_money("l_extendedprice"))
            .otherwise("x").alias("valor_unitario"),
            text_money("l_extendedprice").alias("importe"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_row")),
        "Transacciones_Bancarias": b.raw("events").select(
            folio("E", "event_id").alias("tx_id"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("cuenta_origen_rfc"),
            F.when(F.col("value") > 0.5, F.col("event_type")).alias("cuenta_destino_rfc"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fecha_hora"),
            F.when(F.col("value") < 300, text_money("value")).otherwise("mucho").alias("monto"),
            none.alias("referencia_bancaria"),
            F.when(F.col("event_type") == "click", F.lit(" c1 ")).alias("cfdi_uuid"),
            F.col("event_id").alias("_row")),
    }


def _typed(b: Books, sheet: str) -> DataFrame:
    return canonical.typed_table(sheet, _text_tables(b)[sheet])[0]


@_registered("s3_violations")
def _(b):
    found = None
    for sheet, raw in _text_tables(b).items():
        faults = canonical.typed_table(sheet, raw)[1]
        found = faults if found is None else found.unionByName(faults)
    return found


@_registered("s4_cell_parsers")
def _(b):
    cells = b.raw("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", " dd/MM/yyyy "))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise("1997-13-45").alias("fecha"),
        F.concat(money("o_totalprice").cast("string"),
                 F.when(F.col("o_orderpriority") == "5-LOW", " MXN").otherwise(" "))
        .alias("monto"),
        F.element_at(F.split(F.lit("TRUE,si,Sí,yes,no"), ","),
                     F.substring("o_orderpriority", 1, 1).cast("int")).alias("bandera"))
    return cells.select(
        "o_orderkey", parsing.parse_date(F.col("fecha")).alias("fecha"),
        parsing.parse_money(F.col("monto")).alias("monto"),
        parsing.parse_bool(F.col("bandera")).alias("bandera"))


@_registered("s5a_entities")
def _(b):
    return _typed(b, "Entidades").drop("_row")


@_registered("s5b_blacklist")
def _(b):
    return _typed(b, "Lista_69B").drop("_row")


@_registered("s5c_invoices")
def _(b):
    return _typed(b, "Facturas").drop("_row")


@_registered("s5d_items")
def _(b):
    return _typed(b, "Partidas").drop("_row")


@_registered("s5e_ledger")
def _(b):
    return _typed(b, "Transacciones_Bancarias").drop("_row")


@_registered("s6_last_row_wins")
def _(b):
    rows = b.raw("events").select("user_id", "event_type", money("value").alias("value"),
                                  F.col("event_id").alias("_row"))
    return canonical.last_row_wins(rows, "user_id")


@_registered("s6_blacklist_merge")
def _(b):
    return canonical.merged_blacklist(b.blacklist, _typed(b, "Lista_69B"))


def _own_folder(b: Books) -> str:
    """A new folder on the storage that all executors share."""
    return f"{shared_folder(b.spark).rstrip('/')}/{uuid.uuid4().hex}"


@_registered("s1_read_table")
def _(b):
    """A table written as CSV files and read back as text."""
    folder = f"{_own_folder(b)}/clientes.csv"
    b.raw("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.csv(
        folder, header=True)
    return staging.read_text_table(b.spark, folder, "csv").drop("_row")


@_registered("s1_row_numbers")
def _(b):
    """The numbers of the rows are those from 0 on, each once."""
    folder = f"{_own_folder(b)}/partidas.csv"
    b.raw("lineitem").select("l_orderkey", "l_linenumber").write.csv(folder, header=True)
    return staging.read_text_table(b.spark, folder, "csv").agg(
        F.min("_row").alias("primera"), F.max("_row").alias("ultima"),
        F.count_distinct("_row").alias("distintas"))


@_registered("s8_stored_invoices", stored=True)
def _(b):
    """The invoices of the second of two loads, as the warehouse gives them back."""
    store = warehouse.Warehouse(b.spark, f"{_own_folder(b)}/books")
    store.replace({"entities": b.entities, "invoices": b.invoices.limit(0)})
    store.replace({"entities": b.entities, "invoices": b.invoices})
    return store.table("invoices").select("uuid", "emisor_rfc", "receptor_rfc", "total",
                                          "metodo_pago", "estado_cfdi")


@_registered("s8_expired_loads", stored=True)
def _(b):
    """The rows of the loads that are left, where the first of three is still read."""
    store = warehouse.Warehouse(b.spark, f"{_own_folder(b)}/books")
    store.replace({"invoices": b.invoices})
    with store.reading():
        store.replace({"invoices": b.invoices.where("metodo_pago = 'PUE'")})
        store.replace({"invoices": b.invoices.where("metodo_pago = 'PPD'")})
        store.expire(keep=1, unread=timedelta(0))
    return reduce(DataFrame.unionByName, [
        store.table("invoices", version).agg(
            F.lit(version).alias("version"), F.count("*").alias("n"), F.sum("total").alias("total"))
        for version in store.versions()])


@_registered("s17c_archived_cases", stored=True)
def _(b):
    """The confirmed cases of a run that was archived, beside one that was deleted again."""
    verdicts, resolved = _draft_case(b)
    lines = report.case_document(verdicts, resolved, "2024-01-01 00:00")
    kept = archive.Archive(b.spark, f"{_own_folder(b)}/archive")
    first = kept.save(verdicts, resolved, lines, "plantilla")
    second = kept.save(verdicts, resolved, lines, "plantilla")
    kept.delete(first)
    return kept.open(second)["confirmados"].select(
        "lead_id", "rfc_imputado", "tipo_esquema", "monto_total_evidencia")


@_registered("s17d_deleted_run", stored=True)
def _(b):
    """The archive's headers and leads after one of two runs was deleted."""
    verdicts, resolved = _draft_case(b)
    lines = report.case_document(verdicts, resolved, "2024-01-01 00:00")
    kept = archive.Archive(b.spark, f"{_own_folder(b)}/archive")
    first = kept.save(verdicts, resolved, lines, "plantilla")
    second = kept.save(verdicts, resolved, lines, "plantilla")
    there, again = kept.delete(first), kept.delete(first)
    gone = kept.open(first) is None
    leads_left = kept.open(second)["leads"].agg(F.count("*").alias("n_leads"))
    return leads_left.select(
        "n_leads", F.lit(kept.headers.count()).alias("n_expedientes"), F.lit(there).alias("estaba"), F.lit(again).alias("sigue"),
        F.lit(gone).alias("borrado"))


@_registered("s7_reference_violations", stored=True)
def _(b):
    """Whole tables, some of whose keys are broken."""
    def broken(when, key):
        return F.when(F.expr(when), F.lower(key)).otherwise(F.col(key))
    invoices = b.invoices.withColumns({
        "uuid": F.when(F.col("estado_cfdi") == "CANCELADO", F.concat(F.lit("x"), "uuid"))
        .otherwise(F.col("uuid")),
        "emisor_rfc": broken("total > 50000", "emisor_rfc"),
        "receptor_rfc": broken("total < 2000", "receptor_rfc")})
    ledger = b.ledger.withColumns({
        "cuenta_origen_rfc": broken("monto > 50000", "cuenta_origen_rfc"),
        "cuenta_destino_rfc": broken("monto < 2000", "cuenta_destino_rfc")})
    return integrity.reference_violations({
        "entities": b.entities, "invoices": invoices, "invoice_items": b.items,
        "bank_ledger": ledger})


@_registered("s9_load_counts")
def _(b):
    return canonical.load_counts({"entities": b.entities, "blacklist_69b": b.blacklist,
                                  "invoices": b.invoices, "invoice_items": b.items,
                                  "bank_ledger": b.ledger})


def _raw_lists(b: Books) -> tuple[DataFrame, DataFrame]:
    """Positional rows as the authority's two files have them, with their unusable rows."""
    def rows(table, key, name, balance, nation, rfc, status, date_position):
        date = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.col(nation) * 90),
                             "dd/MM/yyyy")
        cells = {0: F.col(key).cast("string"), 1: F.concat(F.lit(" "), rfc), 2: F.col(name),
                 3: F.when(F.col(balance) > 0, status).otherwise("Sentencia Favorable"),
                 date_position: F.when(F.col(nation) < 22, date).when(
                     F.col(nation) < 24, "pendiente")}
        return b.raw(table).select(*[
            cells.get(i, F.lit(None)).cast("string").alias(f"_c{i}") for i in range(20)],
            F.col(key).cast("long").alias("_row"))
    pair = lambda key: F.floor(F.col(key) / 2).cast("long")  # two rows in a row name one ID
    return (rows("supplier", "s_suppkey", "s_name", "s_acctbal", "s_nationkey",
                 hashed_taxid("S", pair("s_suppkey"), 3), "Definitivo", 15),
            rows("customer", "c_custkey", "c_name", "c_acctbal", "c_nationkey",
                 F.when(F.col("c_mktsegment") == "FURNITURE", hashed_taxid("S", pair("c_custkey"), 3))
                 .otherwise(hashed_taxid("C", pair("c_custkey"), 4)), "Presunto", 7))


def _parsed_lists(b: Books) -> list[DataFrame]:
    return [official_list.parse_official_list(raw, in_file, status, position, "_row")
            for raw, (_, in_file, status, position) in zip(_raw_lists(b), fv.OFFICIAL_LISTS)]


@_registered("s10_official_list")
def _(b):
    first, second = _parsed_lists(b)
    return first.unionByName(second).drop("_row")


@_registered("s11_full_catalog")
def _(b):
    return official_list.full_catalog(official_list.merge_lists(_parsed_lists(b)))


@_registered("s11_recent_final")
def _(b):
    return official_list.recent_final(official_list.merge_lists(_parsed_lists(b)))


@_registered("s12a_header_names")
def _(b):
    name = text.header_name(F.col("text"))
    return b.raw("documents").select("doc_id", F.md5(name).alias("nombre"),
                                     F.length(name).alias("largo"))


def _foreign_table(b: Books) -> DataFrame:
    return b.raw("customer").select(
        customer_id("c_custkey").alias("RFC Contribuyente"), F.col("c_name").alias("Nombre"),
        F.col("c_nationkey").alias("C.P."), F.col("c_mktsegment").alias("Segmento"),
        F.col("c_custkey").alias("_row"))


@_registered("s13_translated")
def _(b):
    tables, _ = foreign.translate(b.spark, {"Padrón de clientes": _foreign_table(b)})
    return tables["Entidades"].drop("_row")


@_registered("s12d_inferred_table")
def _(b):
    """A table whose name says nothing is known by its columns."""
    tables, _ = foreign.translate(b.spark, {"Hoja 1": _foreign_table(b)})
    return tables["Entidades"].drop("_row")


@_registered("s20_canonical_input")
def _(b):
    """The rows of every table of a foreign folder that has one of the five."""
    tables, _ = foreign.canonical_input(b.spark, {"Padrón de clientes": _foreign_table(b)})
    counted = [df.agg(F.lit(name).alias("tabla"), F.count("*").alias("n"))
               for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counted)


# --- documents -------------------------------------------------------------------

def invoice_texts(b: Books) -> DataFrame:
    """One invoice-like text per order, some without a total or a second party."""
    seller, buyer = supplier_id("o_orderkey"), customer_id("o_custkey")
    amount = F.format_number(money("o_totalprice"), 2)
    nl = F.lit("\n")
    return b.raw("orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(
            F.lit("Comprobante\nEmpresa "), F.col("o_orderpriority"), nl,
            F.lit("RFC emisor:\n"), seller, nl,
            F.lit("Folio Fiscal: "), folio("O", "o_orderkey"), nl,
            F.lit("Fecha: "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), nl,
            F.when(F.col("o_orderpriority") == "5-LOW", "Receptor sin datos")
            .otherwise(F.concat(F.lit("RFC receptor: "), buyer)), nl,
            F.lit("Núm. Empleado: 0012 - Persona "), F.col("o_custkey").cast("string"), nl,
            F.when(F.col("o_orderstatus") != "P", F.concat(
                F.lit("Subtotal: "), amount, nl, F.lit("Método de pago: PUE"), nl))
            .otherwise(""),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Total a Pagar: 1.00")
            .otherwise(F.concat(F.lit("Total: "), amount)), nl,
            F.when(F.col("o_orderstatus") == "F",
                   "Descripción: Servicio de flete\nClave Prod. Ser.: 78101800\nCantidad: 2.5\n"
                   "Forma de pago: 03\nLugar de expedición: 64000\n").otherwise(""),
            F.lit("RFC Proveedor: "), customer_id("o_orderkey"), nl,
            F.lit("Cadena Original ||"), folio("X", "o_orderkey"), F.lit("|Total: 9.99||"))
        .alias("text"))


def _fields(b: Books) -> DataFrame:
    return documents.extract_invoice_fields(invoice_texts(b))


@_registered("s14_invoice_fields")
def _(b):
    return _fields(b)


@_registered("s15_entities")
def _(b):
    return documents.invoice_rows(_fields(b))["Entidades"].drop(
        "fecha_constitucion", "representante_legal")


@_registered("s15_invoices")
def _(b):
    return documents.invoice_rows(_fields(b))["Facturas"]


@_registered("s15_items")
def _(b):
    return documents.invoice_rows(_fields(b))["Partidas"]


@_registered("s15_rejected")
def _(b):
    return documents.invoice_rows(_fields(b))["rechazados"]


@_registered("s15_party_review")
def _(b):
    fields = _fields(b)
    parties = fields.select(F.explode(F.array("emisor_rfc", "receptor_rfc")).alias("rfc"))
    known = similarity.known_universe(b.entities, b.blacklist)
    screened = similarity.screen_read_ids(parties.where("rfc is not null"), known)
    return documents.review_parties(fields, screened).select(
        "doc_id", "papel", "rfc", "conocido", "checksum_ok", "motivo", "confiable")


@_registered("s16_document_routes")
def _(b):
    return documents.route_documents(b.raw("documents")).select("doc_id", "ruta")


def _archive_headers(b: Books) -> DataFrame:
    """A run per month of orders."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    return b.raw("orders").groupBy(F.concat(F.lit("EXP-"), month).alias("expediente_id")).agg(
        F.max("o_orderdate").alias("fecha_hora"), F.lit("libros").alias("archivo_origen"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_confirmados"),
        F.count_if(F.col("o_orderstatus") != "F").alias("n_descartados"),
        F.sum(F.when(F.col("o_orderstatus") == "F", money("o_totalprice"))).alias("monto_total"),
        F.lit("plantilla").alias("redactado_por"))


@_registered("s17b_archive_listing")
def _(b):
    return archive.listing(_archive_headers(b), 20)


@_registered("s17f_archive_totals")
def _(b):
    return archive.totals(_archive_headers(b))


@_registered("s18_case_rows", stored=True)
def _(b):
    stored, _ = warehouse.case_rows(_draft_verdicts(b), b.entities)
    return stored.drop("case_id", "fecha_dictamen")


@_registered("s18_skipped_cases", stored=True)
def _(b):
    _, skipped = warehouse.case_rows(_draft_verdicts(b), b.entities)
    return skipped.drop("case_id", "fecha_dictamen")


@_registered("s21_parsed_drafts")
def _(b):
    body = F.concat(
        F.lit('{"rfc_imputado": "'), customer_id("o_custkey"),
        F.lit('", "tipo_esquema": "EFOS_69B", "evidencia": [{"tipo": "factura", "uuid": "'),
        folio("O", "o_orderkey"), F.lit('"}], "regla_fiscal": "69-B", "narrativa": "Orden '),
        F.col("o_orderkey").cast("string"), F.lit('"}'))
    texts = b.raw("orders").select(
        F.col("o_orderkey").alias("lead_id"), customer_id("o_custkey").alias("rfc"),
        F.when(F.col("o_orderpriority") == "1-URGENT", body)
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(
            F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(
            F.lit("Este es el borrador: "), body, F.lit(" y nada mas.")))
        .otherwise("No hay hallazgos.").alias("text"))
    return drafts.parse_drafts(texts).select(
        "lead_id", "rfc_imputado", "tipo_esquema", "regla_fiscal", "narrativa",
        F.size("evidencia").alias("n"), F.get("evidencia", 0)["uuid"].alias("uuid"))


# --- views, tax IDs, lists ----------------------------------------------------------

@_registered("v1_money_network")
def _(b):
    return views.money_network(b.ledger)


@_registered("v2_invoices_against_bank")
def _(b):
    return views.invoices_against_bank(b.invoices, b.ledger)


@_registered("i1_check_character")
def _(b):
    return b.entities.select("rfc", taxid.check_character(F.col("rfc")).alias("digito"))


@_registered("i2_valid_taxid")
def _(b):
    return b.entities.select(
        "rfc", taxid.is_valid_taxid(F.col("rfc")).alias("valido"),
        taxid.is_valid_taxid(F.concat(F.lit(" "), F.lower("rfc"), F.lit(" "))).alias("sin_forma"))


@_registered("i3_bounded_distance")
def _(b):
    return b.raw("part").select(
        "p_partkey", taxid.bounded_distance(F.col("p_name"), F.lower("p_type"), 6)
        .alias("distancia"))


@_registered("i4_known_universe")
def _(b):
    return similarity.known_universe(b.entities, b.blacklist)


def misread_ids(b: Books) -> DataFrame:
    """Customer IDs as a reader may get them: right, one off, two off, or shifted."""
    rfc = customer_id("c_custkey")
    segment = F.col("c_mktsegment")
    return b.raw("customer").select(
        F.when(segment == "BUILDING", rfc)
        .when(segment == "MACHINERY", F.concat(F.left(rfc, F.lit(4)), F.substring(rfc, 6, 8)))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("S"), F.substring(rfc, 2, 10), F.lit("5"),
                                               F.substring(rfc, 13, 1)))
        .when(segment == "FURNITURE", F.concat(F.substring(rfc, 2, 12), F.lit("XYZ")))
        .otherwise(F.lower(F.concat(F.lit(" "), F.substring(rfc, 3, 11)))).alias("rfc"))


@_registered("i5_nearest_known")
def _(b):
    return similarity.nearest_known(
        misread_ids(b), similarity.known_universe(b.entities, b.blacklist))


@_registered("i6_suggestions")
def _(b):
    """All known IDs near a read one that is not known itself."""
    known = similarity.known_universe(b.entities, b.blacklist)
    return similarity.suggestions(misread_ids(b), known)


@_registered("i6_screening")
def _(b):
    return similarity.screen_read_ids(
        misread_ids(b), similarity.known_universe(b.entities, b.blacklist))


@_registered("l1_status_lookup")
def _(b):
    return blacklist.status_lookup(b.entities.select("rfc"), b.blacklist)


@_registered("l2_listed_as_final")
def _(b):
    return blacklist.listed_as_final(b.entities.select("rfc"), b.blacklist)


@_registered("c1_counts_by_status")
def _(b):
    return blacklist.counts_by_status(b.blacklist)


@_registered("c2_search")
def _(b):
    return blacklist.search(b.blacklist, "^[a-h].*[0-4]", ())


@_registered("c2_search_page")
def _(b):
    return blacklist.search_page(b.blacklist, "", ("DEFINITIVO", "PRESUNTO"))


# --- thresholds and cycles ------------------------------------------------------------

@_registered("t1_percentiles")
def _(b):
    fractions = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    found = thresholds.exact_percentiles(b.ledger, "monto", fractions)
    rows = [(f, float(v)) for f, v in zip(fractions, found)]
    return b.spark.createDataFrame(rows, "fraccion double, monto double")


@_registered("t2_t3_thresholds")
def _(b):
    cycle, income = thresholds.amount_thresholds(b.ledger, SETTINGS)
    return b.spark.createDataFrame(
        [(float(cycle), float(income))], "ciclo double, ingreso double")


def _cycles(b: Books, min_amount=None) -> cycles.CycleSearch:
    if min_amount is None:
        min_amount = thresholds.amount_thresholds(b.ledger, SETTINGS)[0]
    # Books that are not stored are better read once, and whole.
    moves = cycles.between_payers(b.ledger) if b.stored else b.ledger
    return cycles.CycleSearch(views.money_network(moves), min_amount,
                              SETTINGS.max_cycle_nodes)


@_registered("g1_money_cycles", stored=True)
def _(b):
    return _cycles(b).cycles()


@_registered("g2_cycle_of")          # the books are read once, and few of their columns
def _(b):
    return cycles.cycle_of(b.entities.select("rfc"), _cycles(b, SETTINGS.proof_min_leg)).select(
        "rfc", "num_saltos", "ciclo", "montos")


# --- materiality -------------------------------------------------------------------------

def _profiles(b: Books, again: bool = False):
    """`again`: the received concepts are read once more, so they are kept."""
    received = materiality.received_concepts(b.invoices, b.items)
    received = settle(received) if again else received
    pairs = settle(received.select("rfc", "concepto").distinct())
    heads, texts = materiality.profiles(pairs, b.catalog, b.invoices, b.items, b.entities)
    return received, pairs, heads, texts


@_registered("m1_folded_text")
def _(b):
    folded = text.fold(F.col("text"))
    return b.raw("documents").select("doc_id", F.md5(folded).alias("texto"),
                                     F.length(folded).alias("largo"))


@_registered("m2a_issued_descriptions")
def _(b):
    return materiality.issued_descriptions(b.invoices, b.items)


@_registered("m2b_profiles", stored=True)
def _(b):
    return _profiles(b)[2]


@_registered("m2c_profile_words", stored=True)
def _(b):
    return materiality.profile_words(_profiles(b)[3])


@_registered("m3_concept_verdicts", stored=True)
def _(b):
    _, pairs, heads, texts = _profiles(b)
    return materiality.concept_verdicts(pairs, heads, texts, SETTINGS)


@_registered("m4_invoice_verdicts", stored=True)
def _(b):
    received, pairs, heads, texts = _profiles(b, again=True)
    return materiality.invoice_verdicts(
        b.invoices, received, materiality.concept_verdicts(pairs, heads, texts, SETTINGS),
        reasons=False)


# --- detectors ----------------------------------------------------------------------------

@_registered("d1_bought_from_listed")
def _(b):
    return detectors.bought_from_listed(b.invoices, b.blacklist)


@_registered("d2_unmatched_payments")
def _(b):
    return detectors.unmatched_payments(b.invoices, b.ledger)


@_registered("d3_cycle_members", stored=True)
def _(b):
    return cycles.cycle_members(_cycles(b))


@_registered("d4_vague_concepts")
def _(b):
    return detectors.vague_concepts(b.invoices, b.items, SETTINGS.vague_terms)


@_registered("d5_undeclared_income")
def _(b):
    return detectors.undeclared_income(
        b.ledger, thresholds.amount_thresholds(b.ledger, SETTINGS)[1])


@_registered("d6_candidates", stored=True)
def _(b):
    floor, income = thresholds.amount_thresholds(b.ledger, SETTINGS)
    return detectors.candidates(b.invoices, b.items, b.ledger, b.blacklist, _cycles(b, floor),
                                income, SETTINGS)


# --- evidence and verdicts ------------------------------------------------------------------

def _draft_evidence(b: Books) -> DataFrame:
    return evidence.resolve_evidence(b.evidence, b.invoices, b.ledger)


def _immaterial(b: Books) -> DataFrame:
    return settle(materiality.immaterial_invoices(         # drawn on a map, and then looked up in
        b.invoices, b.items, b.catalog, b.entities, SETTINGS))


def _draft_proofs(b: Books):
    income = thresholds.amount_thresholds(b.ledger, SETTINGS)[1]
    immaterial = _immaterial(b)
    return evidence.mark_proofs(
        evidence.keep_resolved(_draft_evidence(b)), b.blacklist, immaterial, income), income


def _draft_case(b: Books) -> tuple[DataFrame, DataFrame]:
    """(verdicts, resolved evidence) of the draft leads."""
    income = thresholds.amount_thresholds(b.ledger, SETTINGS)[1]
    immaterial = _immaterial(b)
    resolved = evidence.keep_resolved(_draft_evidence(b))      # the verdicts and the caller read it
    marked = evidence.mark_proofs(resolved, b.blacklist, immaterial, income)
    members = cycles.cycle_members(_cycles(b, SETTINGS.proof_min_leg))
    return settle(evidence.verdicts(b.leads, marked, b.entities, members, income)), resolved


def _draft_verdicts(b: Books) -> DataFrame:
    return _draft_case(b)[0]


@_registered("e1_resolved_evidence", stored=True)
def _(b):
    return _draft_evidence(b)


@_registered("e2_evidence_totals", stored=True)
def _(b):
    return evidence.evidence_totals(_draft_evidence(b))


@_registered("e3_verdicts", stored=True)
def _(b):
    return _draft_verdicts(b).drop("regla_fiscal", "narrativa")


@_registered("e4_proof_69b", stored=True)
def _(b):
    return _draft_proofs(b)[0].where("prueba_69b").select("lead_id").distinct()


@_registered("e5_proof_cycle")       # the books are read once, and few of their columns
def _(b):
    members = cycles.cycle_members(_cycles(b, SETTINGS.proof_min_leg))
    return b.entities.select("rfc").join(members, "rfc", "left_semi")


@_registered("e6_proof_materiality", stored=True)
def _(b):
    return _draft_proofs(b)[0].where("prueba_materialidad").select("lead_id").distinct()


@_registered("e7_proof_income", stored=True)
def _(b):
    """The draft evidence, and each transfer cited against its receiver and its sender."""
    income = thresholds.amount_thresholds(b.ledger, SETTINGS)[1]

    def against(lead_id, accused):
        return b.ledger.select(
            lead_id.alias("lead_id"), F.col(accused).alias("rfc_imputado"),
            F.lit(0).cast("long").alias("pos"), F.lit(fv.TRANSFER_KIND).alias("tipo"),
            F.lit(None).cast("string").alias("uuid"), "tx_id")
    cited = (b.evidence.unionByName(against(F.col("tx_id"), "cuenta_destino_rfc"))
             .unionByName(against(F.concat(F.lit("de:"), "tx_id"), "cuenta_origen_rfc")))
    nothing = b.spark.createDataFrame([], "uuid string, rfc string")
    # Read once, and only transfers can carry this proof, so it is not kept.
    return evidence.mark_proofs(
        evidence.resolve_evidence(cited, b.invoices, b.ledger), b.blacklist, nothing,
        income).where("prueba_ingreso").select("lead_id").distinct()


@_registered("e8a_dossier")
def _(b):
    audited = b.entities.where("es_empresa_auditada").select("rfc")
    return leads.dossier(audited, b.invoices, b.ledger).drop("fecha_hora")


@_registered("e8b_suppliers_with_status")
def _(b):
    audited = b.entities.where("es_empresa_auditada").select("rfc")
    return leads.suppliers_with_status(audited, b.invoices, b.blacklist)


@_registered("e8c_income_without_invoice")
def _(b):
    return leads.income_without_invoice(b.ledger)


@_registered("e8d_counterparty_ledger")
def _(b):
    audited = b.entities.where("es_empresa_auditada").select("rfc")
    return leads.counterparty_ledger(audited, b.ledger)


@_registered("e8e_ranked_cases", stored=True)
def _(b):
    return leads.ranked_cases(_draft_verdicts(b))


@_registered("e8e_cases_by_scheme", stored=True)
def _(b):
    return leads.cases_by_scheme(_draft_verdicts(b))


def _findings(b: Books) -> batch.Findings:
    return batch.investigate(b.entities, b.blacklist, b.invoices, b.items, b.ledger, b.catalog,
                             SETTINGS)


@_registered("e9_proposed_leads", stored=True)
def _(b):
    return _findings(b).leads.select("rfc_imputado", "tipo_esquema")


@_registered("e9_proposed_evidence", stored=True)
def _(b):
    return _findings(b).evidence.select("rfc_imputado", "tipo", "id", "contado_en_total")


@_registered("e10_unseen_dropped_leads", stored=True)
def _(b):
    kept, _ = leads.drop_unseen(b.leads, b.evidence, _seen(b))
    return kept.drop("regla_fiscal", "narrativa")


@_registered("e10_unseen_dropped_evidence", stored=True)
def _(b):
    _, rows = leads.drop_unseen(b.leads, b.evidence, _seen(b))
    return rows


def _seen(b: Books) -> DataFrame:
    return b.invoices.select(F.col("uuid").alias("id")).union(b.ledger.select("tx_id"))


@_registered("p1_batch_verdicts", stored=True)
def _(b):
    return _findings(b).verdicts.select(
        "rfc_imputado", "razon_social", "tipo_esquema", "monto_total_evidencia",
        "estatus_dictamen", "regla_fallida")


# --- case output ---------------------------------------------------------------------------

@_registered("r1_case_document", stored=True)
def _(b):
    return report.case_document(*_draft_case(b), "2024-01-01 00:00")


@_registered("r2_case_context", stored=True)
def _(b):
    return report.case_context(*_draft_case(b))


@_registered("r3_run_summary", stored=True)
def _(b):
    return report.run_summary(_draft_verdicts(b))


def _trail(b: Books):
    found = _findings(b)
    confirmed = found.verdicts.where("confirmado")
    return report.money_trail(confirmed, found.evidence, found.cycles, b.blacklist)


@_registered("r4_trail_edges", stored=True)
def _(b):
    return _trail(b)[0]


@_registered("r4_trail_nodes", stored=True)
def _(b):
    return _trail(b)[1]


@_registered("r5_trail_text", stored=True)
def _(b):
    return report.trail_text(*_trail(b))


@_registered("r6_legends")
def _(b):
    return b.leads.select("lead_id", report.legend(F.col("tipo_esquema")).alias("leyenda"))


@_registered("r7_evidence_rows", stored=True)
def _(b):
    return report.evidence_rows(_draft_evidence(b))


@_registered("r8_case_summary", stored=True)
def _(b):
    return report.case_summary(_draft_verdicts(b))


# --- audits ----------------------------------------------------------------------------------

def answers(b: Books) -> DataFrame:
    """One answer per order about its customer, some of them wrong, plus the documents."""
    rfc, amount = customer_id("o_custkey"), F.format_number(money("o_totalprice"), 2)
    priority = F.col("o_orderpriority")
    said = (F.when(priority == "1-URGENT", F.concat(
                F.lit("No se imputo a "), rfc, F.lit(" por falta de pruebas. ")))
            .when(priority == "2-HIGH", F.concat(
                F.lit("No hay leads descartados; el expediente imputo a "), rfc, F.lit(". ")))
            .when(priority == "3-MEDIUM", F.concat(
                F.lit("Fue exonerada "), F.lower(rfc), F.lit(" en la revision. ")))
            .otherwise(F.concat(F.lit("El monto de "), rfc, F.lit(" es $"), amount,
                                F.lit(" MXN. "))))
    listed = (F.when(F.col("o_orderstatus") == "F", F.concat(
                  F.lit("El proveedor "), supplier_id("o_orderkey"), F.lit(" es solo presunto. ")))
              .when(F.col("o_orderstatus") == "O", F.concat(
                  F.lit("El proveedor "), supplier_id("o_orderkey"),
                  F.lit(" esta en situacion DEFINITIVO. ")))
              .otherwise(""))
    about_orders = b.raw("orders").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("answer_id"),
        F.concat(said, listed, F.lit("Folio "), folio("O", "o_orderkey")).alias("text"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Que paso con "), rfc, F.lit("?")))
        .alias("question"))
    about_documents = b.raw("documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("answer_id"),
        F.concat(F.col("text"), F.lit(" No acuse a "), customer_id("doc_id"), F.lit(", "),
                 F.col("text")).alias("text"),
        F.lit(None).cast("string").alias("question"))
    return about_orders.unionByName(about_documents)


def _confirmed_buyers(b: Books) -> tuple[DataFrame, DataFrame]:
    """Cases and cited rows of everyone who bought from a finally listed supplier."""
    bought = b.invoices.select("uuid", F.col("emisor_rfc").alias("rfc"), "receptor_rfc", "total")
    rows = blacklist.listed_as_final(bought, b.blacklist).select(
        F.col("receptor_rfc").alias("lead_id"), F.col("receptor_rfc").alias("rfc_imputado"),
        F.col("total").alias("monto"))
    cases = rows.groupBy("lead_id", "rfc_imputado").agg(
        F.sum("monto").alias("monto_total_evidencia"))
    return cases, rows


@_registered("a1_cited_identifiers")
def _(b):
    return audits.cited_identifiers(answers(b))


@_registered("a2_invented_identifiers")
def _(b):
    seen = b.raw("orders").where("o_orderpriority <> '5-LOW'").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("answer_id"),
        folio("O", "o_orderkey").alias("id"))
    return audits.invented_identifiers(answers(b), seen)


@_registered("a3_denied_cases")
def _(b):
    return audits.denied_cases(answers(b), _confirmed_buyers(b)[0])


def _named_answers(b: Books) -> DataFrame:
    """Answers about customers under their names, which have not the shape of a tax ID: one
    per order, and each document with a name in the middle of it."""
    priority = F.col("o_orderpriority")
    amount = F.format_number(money("o_totalprice"), 2)
    about = b.raw("orders").join(b.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    said = (F.when(priority == "1-URGENT", F.concat(
                F.lit("No se imputo a "), F.col("c_name"), F.lit(" por falta de pruebas.")))
            .when(priority == "2-HIGH", F.concat(
                F.lit("No hay leads descartados; el expediente imputo a "), F.col("c_name")))
            .when(priority == "3-MEDIUM", F.concat(
                F.lit("Fue exonerada "), F.upper("c_name"), F.lit(" en la revision.")))
            .otherwise(F.concat(F.lit("El monto de "), F.col("c_name"), F.lit(" es $"), amount,
                                F.lit(" MXN."))))
    by_order = about.select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("answer_id"),
        said.alias("text"))
    name = F.format_string("Customer#%09d", F.col("doc_id") % 2000)
    by_document = b.raw("documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("answer_id"),
        F.concat(F.col("text"), F.lit(" No acuse a "), name, F.lit(", "), F.col("text"))
        .alias("text"))
    return by_order.unionByName(by_document)


@_registered("a3_denied_odd_ids", stored=True)
def _(b):
    """Confirmed are the customers with a positive balance, by name."""
    confirmed = b.raw("customer").where("c_acctbal > 0").select(
        F.col("c_name").alias("rfc_imputado"))
    return audits.denied_cases(_named_answers(b), confirmed)


@_registered("a5_swapped_odd_ids", stored=True)
def _(b):
    """Each customer's case is worth its largest order; answers name all its orders."""
    amounts = settle(b.raw("orders").join(
        b.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_name").alias("rfc")).agg(F.max(money("o_totalprice")).cast("decimal(24,2)")
                                          .alias("monto")))
    rotated = b.raw("customer").select(
        F.col("c_name").alias("rfc"), F.format_string(
            "Customer#%09d", F.col("c_custkey") + 7).alias("otro"))
    said = rotated.join(amounts.select(F.col("rfc").alias("otro"), F.col("monto").alias("_m")),
                        "otro").select(
        F.concat(F.lit("R"), F.col("rfc")).alias("answer_id"),
        F.concat(F.lit("El caso "), F.col("rfc"), F.lit(" suma $"), F.format_number("_m", 2),
                 F.lit(" MXN")).alias("text"))
    return audits.swapped_amounts(said.unionByName(_named_answers(b)), amounts)


@_registered("a4_wrong_list_status")
def _(b):
    return audits.wrong_list_status(answers(b), b.blacklist)


def _swapped_answers(b: Books, amounts: DataFrame) -> DataFrame:
    """Per confirmed amount, an answer that gives it to its owner and then to another buyer,
    and per invoice one that gives its total to the receiver."""
    owner = amounts.select("rfc", "monto")
    others = b.invoices.select(
        F.col("receptor_rfc").alias("rfc"), F.col("total").cast("decimal(24,2)").alias("monto")
    ).distinct()                    # before the texts are made: each has one ID and one amount
    said = lambda who, amount: F.concat(
        F.lit("El caso "), who, F.lit(" suma $"), F.format_number(amount, 2), F.lit(" MXN"))
    swapped = b.raw("orders").select(
        customer_id("o_custkey").alias("otro"), money("o_totalprice").alias("m"),
        F.col("o_orderkey"))
    first = owner.groupBy("rfc").agg(F.max("monto").alias("monto"))
    by_order = swapped.join(first.select(F.col("rfc").alias("otro"), "monto"), "otro").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("answer_id"),
        F.concat(said(F.col("otro"), F.col("monto")), F.lit("; "),
                 said(customer_id("o_orderkey"), F.col("monto"))).alias("text"))
    by_invoice = others.withColumn("answer_id", F.concat(
        F.lit("I"), F.col("rfc"), F.lit("/"), F.col("monto").cast("string"))).select(
        "answer_id", said(F.col("rfc"), F.col("monto")).alias("text"))
    return by_order.unionByName(by_invoice)


@_registered("a5_swapped_amounts", stored=True)
def _(b):
    cases, rows = _confirmed_buyers(b)
    amounts = settle(audits.case_amounts(cases, rows))
    return audits.swapped_amounts(_swapped_answers(b, amounts), amounts)


@_registered("a6_report_reconciliation", stored=True)
def _(b):
    verdicts, resolved = _draft_case(b)
    lines = report.case_document(verdicts, resolved, "2024-01-01 00:00")
    return audits.reconcile_report(
        lines, b.invoices, b.ledger, b.entities,
        verdicts.where("confirmado").select(F.col("monto_total_evidencia").alias("monto")))


@_registered("q1_guarded_sql")
def _(b):
    sqlgate.register({"entities": b.entities, "invoices": b.invoices, "invoice_items": b.items,
                      "bank_ledger": b.ledger, "blacklist_69b": b.blacklist})
    return sqlgate.query(b.spark, """
        SELECT f.receptor_rfc AS rfc, count(*) AS n, sum(f.discrepancia) AS falta
        FROM v_facturas_sin_pago_bancario f JOIN entities e ON e.rfc = f.receptor_rfc
        WHERE abs(f.discrepancia) > 1 GROUP BY f.receptor_rfc;""")


@_registered("r1_numbered_cases")
def _(b):
    """The consecutive case numbers on their own, over every order."""
    return ranking.numbered(
        b.leads.select("lead_id", "rfc_imputado"), "numero", "rfc_imputado", "lead_id")
