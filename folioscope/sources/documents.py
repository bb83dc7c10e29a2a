"""S14-S16. Invoices read from the text of documents, all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.text import strip
from folioscope.session import settle

_AMOUNTS = ("subtotal", "total", "valor_unitario", "importe")
_REQUIRED = ("uuid", "emisor_rfc", "receptor_rfc", "total")


def route_documents(documents: DataFrame, text: str = "text",
                    min_chars: int = fv.DOCUMENT_MIN_CHARS) -> DataFrame:
    """S16. Adds `ruta`: TEXTO when there is enough text to read, else NECESITA_OCR."""
    return documents.withColumn(
        "ruta", F.when(F.length(F.coalesce(text, F.lit(""))) >= min_chars, "TEXTO")
        .otherwise("NECESITA_OCR"))


def _first(pattern: str, text: Column) -> Column:
    """First group of the first match, trimmed; null without a match."""
    found = strip(F.regexp_extract(text, pattern, 1))
    return F.when(found != "", found)


def _first_whole(pattern: str, text: Column) -> Column:
    found = F.regexp_extract(text, pattern, 0)
    return F.when(found != "", found)


def _number(text: Column, dtype: str) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast(dtype)


def extract_invoice_fields(documents: DataFrame, doc_id: str = "doc_id",
                           text: str = "text") -> DataFrame:
    """S14. One row of invoice fields per document, null where the text has none.

    The seal block repeats identifiers in a long signature and is cut off first.
    The stamping provider is not a party, so its ID is taken out; it is looked for
    in the uncut text.
    """
    body = F.regexp_replace(F.col(text), fv.SEAL_BLOCK_PATTERN, "")
    base = documents.select(
        F.col(doc_id), body.alias("cuerpo"),
        _first(fv.STAMPER_PATTERN, F.col(text)).alias("rfc_pac"))
    parties = F.filter(
        F.array_distinct(F.regexp_extract_all("cuerpo", F.lit(fv.TAXID_PATTERN), F.lit(0))),
        lambda r: F.col("rfc_pac").isNull() | (r != F.col("rfc_pac")))
    base = base.withColumn("_parties", parties).withColumn(
        "emisor_rfc", F.get("_parties", 0)).withColumn("receptor_rfc", F.get("_parties", 1))

    body = F.col("cuerpo")
    fields = {}
    for name, pattern in fv.INVOICE_TEXT_PATTERNS.items():
        value = _first(pattern, body)
        if name in _AMOUNTS:
            value = _number(value, "decimal(14,2)")
        elif name == "cantidad":
            value = _number(value, "decimal(10,2)")
        fields[name] = value

    lines = F.transform(F.split(body, r"\R"), strip)
    issuer_line = F.array_position(
        F.transform(lines, lambda s: F.contains(s, F.col("emisor_rfc"))), F.lit(True)).cast("int")
    above = F.filter(
        F.slice(lines, F.lit(1), F.greatest(issuer_line - 1, F.lit(0))),
        lambda s: (F.length(s) > 3) & ~F.endswith(s, F.lit(":")))
    issuer_name = F.when(F.col("emisor_rfc").isNotNull(), F.try_element_at(above, F.lit(-1)))
    receiver_name = strip(F.regexp_replace(
        _first(fv.EMPLOYEE_LINE_PATTERN, body), fv.EMPLOYEE_NUMBER_PREFIX, ""))
    # A one-row generator: a later filter on a field reads the value found here, where a
    # plain projection would be searched again for every use of it.
    return base.select(doc_id, F.inline(F.array(F.struct(
        _first_whole(fv.UUID_PATTERN, body).alias("uuid"), F.col("emisor_rfc"),
        F.col("receptor_rfc"), F.col("rfc_pac"),
        _first_whole(fv.ISO_TIMESTAMP_PATTERN, body).alias("fecha_emision"),
        *[value.alias(name) for name, value in fields.items()],
        issuer_name.alias("razon_social_emisor"),
        receiver_name.alias("razon_social_receptor")))))


def _given(name: str) -> Column:
    """The field unless it is empty; a zero amount counts as missing too."""
    if name in _AMOUNTS or name == "cantidad":
        return F.when(F.col(name) != 0, F.col(name))
    return F.when(F.col(name) != "", F.col(name))


def missing_fields(fields: DataFrame) -> DataFrame:
    """Adds `faltantes`, the required fields a document does not give."""
    return fields.withColumn("faltantes", F.array_compact(F.array(
        *[F.when(_given(name).isNull(), F.lit(name)) for name in _REQUIRED])))


def invoice_rows(fields: DataFrame, doc_id: str = "doc_id") -> dict[str, DataFrame]:
    """S15. Canonical text tables from extracted fields, plus the documents left out.

    Keys: Entidades, Facturas, Partidas (each with doc_id) and rechazados. The fields
    feed all four, so they are extracted once.
    """
    marked = settle(missing_fields(fields))
    usable = marked.where(F.size("faltantes") == 0)
    fallback = fv.DOCUMENT_DEFAULTS
    none = F.lit(None).cast("string")

    def company(rfc, name, postal, audited):
        return F.struct(
            F.col(rfc).alias("rfc"), F.coalesce(_given(name), F.col(rfc)).alias("razon_social"),
            none.alias("fecha_constitucion"), none.alias("representante_legal"),
            F.coalesce(_given(postal), F.lit(fallback["codigo_postal"])).alias("codigo_postal"),
            F.lit(audited).alias("es_empresa_auditada"))

    entities = usable.select(doc_id, F.explode(F.array(
        company("emisor_rfc", "razon_social_emisor", "cp_emisor", "TRUE"),
        company("receptor_rfc", "razon_social_receptor", "cp_receptor", "FALSE"))).alias("e")
    ).select(doc_id, "e.*")
    invoices = usable.select(
        doc_id, "uuid", "emisor_rfc", "receptor_rfc", "fecha_emision",
        F.coalesce(_given("subtotal"), "total").alias("subtotal"), "total",
        F.left(F.coalesce(_given("metodo_pago"), F.lit(fallback["metodo_pago"])), F.lit(3))
        .alias("metodo_pago"),
        F.coalesce(_given("forma_pago"), F.lit(fallback["forma_pago"])).alias("forma_pago"),
        F.lit(fallback["estado_cfdi"]).alias("estado_cfdi"))
    items = usable.select(
        doc_id, F.col("uuid").alias("invoice_uuid"),
        F.coalesce(_given("clave_prod_serv"), F.lit(fallback["clave_prod_serv"]))
        .alias("clave_prod_serv"),
        F.coalesce(_given("descripcion"), F.lit(fallback["descripcion"])).alias("descripcion"),
        F.coalesce(_given("cantidad"), F.lit(1).cast("decimal(10,2)")).alias("cantidad"),
        F.coalesce(_given("valor_unitario"), "total").alias("valor_unitario"),
        F.coalesce(_given("importe"), "total").alias("importe"))
    rejected = marked.where(F.size("faltantes") > 0).select(
        doc_id, F.array_join("faltantes", ", ").alias("faltantes"))
    return {"Entidades": entities, "Facturas": invoices, "Partidas": items,
            "rechazados": rejected}


def canonical_sheets(documents: DataFrame, doc_id: str = "doc_id",
                     text: str = "text") -> tuple[dict[str, DataFrame], DataFrame]:
    """S15, S20. (text tables as a folder of tables would have them, report) of documents.

    Only documents with enough text are read; the report lists the others, too.
    """
    routed = route_documents(documents, text)
    fields = settle(extract_invoice_fields(routed.where(F.col("ruta") == "TEXTO"), doc_id, text))
    rows = invoice_rows(fields, doc_id)
    sheets = {}
    for sheet in ("Entidades", "Facturas", "Partidas"):
        # Later rows of a key replace earlier ones, so the places are fixed by writing them.
        sheets[sheet] = settle(rows[sheet].select(
            *[F.col(c).cast("string").alias(c) for c in fv.REQUIRED_COLUMNS[sheet]],
            F.monotonically_increasing_id().alias("_row")))
    note = lambda df, kind, value: df.select(
        F.col(doc_id).cast("string").alias("documento"), F.lit(kind).alias("nota"),
        value.cast("string").alias("valor"))
    report = (note(rows["rechazados"], "FALTAN_CAMPOS", F.col("faltantes"))
              .unionByName(note(routed.where(F.col("ruta") != "TEXTO"), "SIN_TEXTO", F.col("ruta")))
              .unionByName(note(fields.where("rfc_pac is not null"), "TIMBRADO_IGNORADO",
                                F.col("rfc_pac")))
              .unionByName(note(rows["Entidades"].where("es_empresa_auditada = 'TRUE'"),
                                "AUDITADA", F.col("rfc"))))
    return sheets, report


def review_parties(fields: DataFrame, screened: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """S15. The screening verdict of each party a document names."""
    named = missing_fields(fields).where(F.size("faltantes") == 0).select(doc_id, F.explode(
        F.array(F.struct(F.lit("emisor_rfc").alias("papel"), F.col("emisor_rfc").alias("rfc")),
                F.struct(F.lit("receptor_rfc").alias("papel"), F.col("receptor_rfc").alias("rfc")))
    ).alias("p")).select(doc_id, "p.*")
    return named.join(screened, "rfc", "left")
