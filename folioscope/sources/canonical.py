"""S3-S6, S9. Text tables to typed tables, with every fault reported as a row.

Each table is one projection: it types the columns and lists the row's faults
side by side, so good rows and faults come from the same scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope import schema
from folioscope.functions.parsing import parse_bool, parse_date, parse_money, parse_timestamp
from folioscope.functions.text import strip
from folioscope.sources.staging import require_columns

VIOLATION = "tabla string, columna string, fila long, valor string, regla string"
_FAULT = "struct<columna:string,valor:string,regla:string>"

KEYS = {"Entidades": "rfc", "Lista_69B": "rfc", "Facturas": "uuid",
        "Transacciones_Bancarias": "tx_id"}


def _upper(name: str) -> Column:
    return F.upper(strip(F.col(name)))


def _entities() -> dict[str, tuple[Column, str | None]]:
    """Per column: its typed expression, and the rule broken when that gives null for a value."""
    return {
        "rfc": (strip(F.col("rfc")), None),
        "razon_social": (strip(F.col("razon_social")), None),
        "fecha_constitucion": (parse_date(F.col("fecha_constitucion")), "FECHA_INVALIDA"),
        "representante_legal": (strip(F.col("representante_legal")), None),
        "codigo_postal": (F.lpad(strip(F.col("codigo_postal")), 5, "0"), None),
        "es_empresa_auditada": (parse_bool(F.col("es_empresa_auditada")), None),
    }


def _blacklist():
    status, amount = _upper("situacion"), F.col("monto_presunto_total")
    return {
        "rfc": (strip(F.col("rfc")), None),
        "situacion": (F.when(status.isin(*fv.LIST_STATUSES), status), "SITUACION_INVALIDA"),
        "publicacion_dof": (parse_date(F.col("publicacion_dof")), "FECHA_INVALIDA"),
        "monto_presunto_total": (
            F.when(amount.isNull(), F.lit(0).cast("decimal(14,2)")).otherwise(parse_money(amount)),
            "NUMERO_INVALIDO"),
    }


def _invoices():
    method, state = _upper("metodo_pago"), _upper("estado_cfdi")
    return {
        "uuid": (strip(F.col("uuid")), None),
        "emisor_rfc": (strip(F.col("emisor_rfc")), None),
        "receptor_rfc": (strip(F.col("receptor_rfc")), None),
        "fecha_emision": (parse_timestamp(F.col("fecha_emision")), "FECHA_INVALIDA"),
        "subtotal": (parse_money(F.col("subtotal")), "NUMERO_INVALIDO"),
        "total": (parse_money(F.col("total")), "NUMERO_INVALIDO"),
        "metodo_pago": (F.when(method.isin(*fv.PAYMENT_METHODS), method), "METODO_INVALIDO"),
        "forma_pago": (strip(F.col("forma_pago")), None),
        "estado_cfdi": (F.when(state.isin(*fv.INVOICE_STATES), state).otherwise("VIGENTE"), None),
    }


def _items():
    return {
        "invoice_uuid": (strip(F.col("invoice_uuid")), None),
        "clave_prod_serv": (strip(F.col("clave_prod_serv")), None),
        "descripcion": (strip(F.col("descripcion")), None),
        "cantidad": (parse_money(F.col("cantidad"), "decimal(10,2)"), "NUMERO_INVALIDO"),
        "valor_unitario": (parse_money(F.col("valor_unitario")), "NUMERO_INVALIDO"),
        "importe": (parse_money(F.col("importe")), "NUMERO_INVALIDO"),
    }


def _ledger():
    return {
        "tx_id": (strip(F.col("tx_id")), None),
        "cuenta_origen_rfc": (strip(F.col("cuenta_origen_rfc")), None),
        "cuenta_destino_rfc": (strip(F.col("cuenta_destino_rfc")), None),
        "fecha_hora": (parse_timestamp(F.col("fecha_hora")), "FECHA_INVALIDA"),
        "monto": (parse_money(F.col("monto")), "NUMERO_INVALIDO"),
        "referencia_bancaria": (strip(F.col("referencia_bancaria")), None),
        "cfdi_uuid": (strip(F.col("cfdi_uuid")), None),
    }


_COLUMNS = {"Entidades": _entities, "Lista_69B": _blacklist, "Facturas": _invoices,
            "Partidas": _items, "Transacciones_Bancarias": _ledger}
# A null payment method is reported as an invalid one; the others as missing.
_DOMAIN_NOT_NULL = {"Facturas": ("metodo_pago",)}


def typed_table(sheet: str, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3-S5. (typed rows with `_row`, violations) of one table of text.

    `fila` is the row number a person sees in the source: header first, counted from 1.
    """
    if sheet == "Lista_69B" and any(
            c not in raw.columns for c in fv.REQUIRED_COLUMNS[sheet]) and raw.isEmpty():
        spark = raw.sparkSession
        empty = spark.createDataFrame([], schema.BLACKLIST)
        return (empty.withColumn("_row", F.lit(0).cast("long")),
                spark.createDataFrame([], VIOLATION))
    require_columns(raw, sheet)
    columns = _COLUMNS[sheet]()
    faults = []
    for name, (value, rule) in columns.items():
        def fault(broken: Column, label: str) -> Column:
            return F.when(broken, F.struct(
                F.lit(name).alias("columna"), F.col(name).alias("valor"),
                F.lit(label).alias("regla")))
        if name in fv.NOT_NULL_COLUMNS[sheet]:
            faults.append(fault(F.col(name).isNull(), "VALOR_NULO"))
        if rule:
            given = (F.lit(True) if name in _DOMAIN_NOT_NULL.get(sheet, ())
                     else F.col(name).isNotNull())
            faults.append(fault(given & value.isNull(), rule))
    listed = F.filter(F.array(*faults), lambda f: f.isNotNull()).cast(f"array<{_FAULT}>")
    both = raw.select(
        "_row", listed.alias("_faults"), *[v.alias(n) for n, (v, _) in columns.items()])
    violations = both.where(F.size("_faults") > 0).select(
        F.lit(sheet).alias("tabla"), F.explode("_faults").alias("f"),
        (F.col("_row") + 2).alias("fila")).select(
        "tabla", "f.columna", "fila", "f.valor", "f.regla")
    return both.where(F.size("_faults") == 0).drop("_faults").select(*columns, "_row"), violations


def last_row_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """S6. One row per key, the last in load order; a later load is later than any row of an
    earlier one."""
    order = order or ("_row",)
    kept = [c for c in rows.columns if c not in (key, *order)]
    latest = rows.groupBy(key).agg(
        F.max_by(F.struct(*kept), F.struct(*order)).alias("_v"))
    return latest.select(*[F.col(key) if c == key else F.col(f"_v.{c}").alias(c)
                           for c in rows.columns if c not in order])


def merged_blacklist(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """S6. The stored list with a new load on top."""
    older = stored.select(*schema.BLACKLIST.names).withColumn("_load", F.lit(0)).withColumn(
        "_row", F.lit(0).cast("long"))
    newer = incoming.select(*schema.BLACKLIST.names, F.lit(1).alias("_load"), "_row")
    return last_row_wins(older.unionByName(newer), "rfc", "_load", "_row")


def load_counts(typed: dict[str, DataFrame]) -> DataFrame:
    """S9. (tabla, n): input rows per table, before any row replaces another."""
    tagged = [df.select(F.lit(name).alias("tabla")) for name, df in typed.items()]
    return reduce(DataFrame.union, tagged).groupBy("tabla").agg(F.count("*").alias("n"))
