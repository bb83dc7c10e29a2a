"""Canonical schemas. Money is decimal, so sums do not depend on row order."""

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
QUANTITY = T.DecimalType(10, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


ENTITIES = _schema(
    ("rfc", T.StringType()), ("razon_social", T.StringType()),
    ("fecha_constitucion", T.DateType()), ("representante_legal", T.StringType()),
    ("codigo_postal", T.StringType()), ("es_empresa_auditada", T.BooleanType()))
BLACKLIST = _schema(
    ("rfc", T.StringType()), ("situacion", T.StringType()),
    ("publicacion_dof", T.DateType()), ("monto_presunto_total", MONEY))
INVOICES = _schema(
    ("uuid", T.StringType()), ("emisor_rfc", T.StringType()), ("receptor_rfc", T.StringType()),
    ("fecha_emision", T.TimestampNTZType()), ("subtotal", MONEY), ("total", MONEY),
    ("metodo_pago", T.StringType()), ("forma_pago", T.StringType()),
    ("estado_cfdi", T.StringType()))
ITEMS = _schema(
    ("invoice_uuid", T.StringType()), ("clave_prod_serv", T.StringType()),
    ("descripcion", T.StringType()), ("cantidad", QUANTITY), ("valor_unitario", MONEY),
    ("importe", MONEY), ("_row", T.LongType()))
LEDGER = _schema(
    ("tx_id", T.StringType()), ("cuenta_origen_rfc", T.StringType()),
    ("cuenta_destino_rfc", T.StringType()), ("fecha_hora", T.TimestampNTZType()),
    ("monto", MONEY), ("referencia_bancaria", T.StringType()), ("cfdi_uuid", T.StringType()))
CASES = _schema(
    ("case_id", T.StringType()), ("rfc_imputado", T.StringType()),
    ("tipo_esquema", T.StringType()), ("monto_total_evidencia", T.DecimalType(24, 2)),
    ("estatus_dictamen", T.StringType()), ("justificacion_legal", T.StringType()),
    ("regla_violada", T.StringType()), ("fecha_dictamen", T.TimestampNTZType()))
SECTOR_CATALOG = _schema(
    ("rfc", T.StringType()), ("razon_social", T.StringType()), ("giro", T.StringType()),
    ("claves_esperadas", T.ArrayType(T.StringType())),
    ("descripciones_esperadas", T.ArrayType(T.StringType())))
DRAFT = _schema(
    ("rfc_imputado", T.StringType()), ("tipo_esquema", T.StringType()),
    ("evidencia", T.ArrayType(_schema(
        ("tipo", T.StringType()), ("uuid", T.StringType()), ("tx_id", T.StringType())))),
    ("regla_fiscal", T.StringType()), ("narrativa", T.StringType()))

CASE_TABLES = {"entities": ENTITIES, "invoices": INVOICES, "invoice_items": ITEMS,
               "bank_ledger": LEDGER}
REFERENCE_TABLES = {"blacklist_69b": BLACKLIST}

# Which canonical table each input sheet fills.
TABLE_OF_SHEET = {
    "Entidades": "entities", "Lista_69B": "blacklist_69b", "Facturas": "invoices",
    "Partidas": "invoice_items", "Transacciones_Bancarias": "bank_ledger"}
