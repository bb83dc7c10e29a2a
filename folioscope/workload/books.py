"""The benchmark tables read as a set of books.

Suppliers, customers and event users are the entities; an order's lines per
supplier are one invoice; lines are items and payments; purchase events are
transfers without an invoice. Everything is an expression over the whole tables,
and `oracle_books.py` states the same in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.folios import dashed
from folioscope.session import settle, tune
from folioscope.settings import Settings

# The parts vocabulary of the benchmark stands in for invoice concepts.
SETTINGS = Settings(generic_terms=("economy", "promo"), vague_terms=("economy hot", "promo old"))

_HEX = "0123456789abcdef"
_LETTERS = "ABCDEFGHIJKLMNOP"


def taxid(kind: str | Column, key: Column, letters: int | Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    letters = F.lit(letters) if isinstance(letters, int) else letters
    h = F.md5(F.concat(kind, F.lit(":"), key.cast("string")))
    return F.concat(
        F.translate(F.substring(h, F.lit(1), letters), _HEX, _LETTERS),
        F.translate(F.substring(h, letters + 1, F.lit(6)), "abcdef", "012345"),
        F.upper(F.substring(h, letters + 7, F.lit(3))))


def supplier_id(key: str) -> Column:
    return taxid("S", F.col(key), 3)


def customer_id(key: str) -> Column:
    return taxid("C", F.col(key), 4)


def customer_or_supplier(customer: Column) -> Column:
    """The tax ID of an invoice's customer or supplier; one hash, whichever it is."""
    return taxid(F.when(customer, "C").otherwise("S"),
                 F.when(customer, F.col("o_custkey")).otherwise(F.col("l_suppkey")),
                 F.when(customer, 4).otherwise(3))


def user_id(key: Column) -> Column:
    return taxid("U", key, 3)


def folio(kind: str, *parts) -> Column:
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return dashed(F.md5(F.concat_ws(":", F.lit(kind), *cols)))


def money(name: str) -> Column:
    return F.col(name).cast("decimal(14,2)")


class Books:
    """Canonical tables as lazy DataFrames over one benchmark folder.

    With `stored`, what needs a join or a grouping is written on first use, by the benchmark's
    keys. Queries of many steps work on that, so nothing is joined twice; folios and tax IDs,
    which take several times the room, are made where they are read.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self.stored = stored

    def _kept(self, df: DataFrame) -> DataFrame:
        return settle(df) if self.stored else df

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @cached_property
    def entities(self) -> DataFrame:
        nothing = F.lit(None).cast("string")
        postal = lambda c: F.lpad(F.col(c).cast("string"), 5, "0").alias("codigo_postal")
        no_date = F.lit(None).cast("date").alias("fecha_constitucion")
        suppliers = self.raw("supplier").select(
            supplier_id("s_suppkey").alias("rfc"), F.col("s_name").alias("razon_social"), no_date,
            nothing.alias("representante_legal"), postal("s_nationkey"),
            F.lit(False).alias("es_empresa_auditada"))
        customers = self.raw("customer").select(
            customer_id("c_custkey").alias("rfc"), F.col("c_name").alias("razon_social"), no_date,
            nothing.alias("representante_legal"), postal("c_nationkey"),
            (F.col("c_mktsegment") == "MACHINERY").alias("es_empresa_auditada"))
        users = self.raw("events").select("user_id").distinct().select(
            user_id(F.col("user_id")).alias("rfc"),
            F.concat(F.lit("Usuario "), F.col("user_id").cast("string")).alias("razon_social"),
            no_date, nothing.alias("representante_legal"), F.lit("00000").alias("codigo_postal"),
            F.lit(False).alias("es_empresa_auditada"))
        return self._kept(suppliers.unionByName(customers).unionByName(users))

    @cached_property
    def blacklist(self) -> DataFrame:
        balance = F.col("s_acctbal")
        return self._kept(self.raw("supplier").where(balance < 1000).select(
            supplier_id("s_suppkey").alias("rfc"),
            F.when(balance < -700, fv.STATUS_FINAL).when(balance < 0, fv.STATUS_PRESUMED)
            .otherwise(fv.STATUS_CLEARED).alias("situacion"),
            F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_nationkey") * 90)
            .alias("publicacion_dof"),
            F.abs(money("s_acctbal")).alias("monto_presunto_total")))

    @cached_property
    def invoices(self) -> DataFrame:
        # Dealt by order at once, so that lines are not shuffled again to meet their orders.
        billed = (self.raw("lineitem").where(F.col("l_orderkey").isNotNull())
                  .select("l_orderkey", "l_suppkey", "l_extendedprice").repartition("l_orderkey")
                  .groupBy("l_orderkey", "l_suppkey")
                  .agg(F.sum(money("l_extendedprice")).cast("decimal(14,2)").alias("total")))
        low = F.col("o_orderpriority") == "5-LOW"
        billed = self._kept(billed.join(
            self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            "l_orderkey", "l_suppkey", "o_custkey", "o_orderdate", "o_orderpriority",
            "o_orderstatus", "total"))
        return billed.select(
            folio("I", "l_orderkey", "l_suppkey").alias("uuid"),
            customer_or_supplier(low).alias("emisor_rfc"),
            customer_or_supplier(~F.coalesce(low, F.lit(False))).alias("receptor_rfc"),
            F.col("o_orderdate").alias("fecha_emision"), F.col("total").alias("subtotal"), "total",
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "PUE").otherwise("PPD")
            .alias("metodo_pago"), F.lit("03").alias("forma_pago"),
            F.when(low | (F.col("o_orderstatus") == "P"), "CANCELADO").otherwise("VIGENTE")
            .alias("estado_cfdi"))

    @cached_property
    def items(self) -> DataFrame:
        sold = self._kept(self.raw("lineitem").join(
            self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber",
            F.concat_ws(" ", "p_type", "p_name").alias("descripcion"),
            F.col("l_quantity").cast("decimal(10,2)").alias("cantidad"),
            money("p_retailprice").alias("valor_unitario"), money("l_extendedprice")
            .alias("importe")))
        return sold.select(
            folio("I", "l_orderkey", "l_suppkey").alias("invoice_uuid"),
            F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("clave_prod_serv"),
            "descripcion", "cantidad", "valor_unitario", "importe",
            F.col("l_linenumber").cast("long").alias("_row"))

    @staticmethod
    def payment_folio(price: Column | None = None) -> Column:
        return folio("P", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     money("l_extendedprice") if price is None else price)

    @cached_property
    def _lines(self) -> DataFrame:
        """Every line with what the ledger and the evidence need of its order. Stored by keys:
        tax IDs and folios are made of them where they are read."""
        returned = F.col("l_returnflag")
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_linestatus",
            money("l_extendedprice").alias("importe"),
            ((returned == "R") & (F.col("l_discount") > 0.095) & (F.col("l_tax") > 0.075))
            .alias("short"),
            ((returned == "R") & (F.col("l_tax") > 0.075)).alias("pays"),
            ((returned == "A") & (F.col("l_discount") < 0.005)).alias("foreign"),
            (F.col("l_quantity") >= 50).alias("absent"), (F.col("l_quantity") == 49).alias("odd"))
        orders = self.raw("orders").select(
            "o_orderkey", "o_custkey", (F.col("o_orderpriority") != "5-LOW").alias("se_paga"),
            self._small().alias("small"))
        return self._kept(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))

    @cached_property
    def ledger(self) -> DataFrame:
        """Orders that are not LOW are paid line by line, a few lines 5.00 short."""
        paid = self._lines.where("se_paga").select(
            self.payment_folio(F.col("importe")).alias("tx_id"),
            customer_id("o_custkey").alias("cuenta_origen_rfc"),
            supplier_id("l_suppkey").alias("cuenta_destino_rfc"),
            F.col("l_shipdate").alias("fecha_hora"),
            F.when(F.col("short"), F.col("importe") - 5).otherwise(F.col("importe"))
            .cast("decimal(14,2)").alias("monto"),
            F.lit("pago").alias("referencia_bancaria"),
            folio("I", "l_orderkey", "l_suppkey").alias("cfdi_uuid"))
        events = self.raw("events")
        users = events.select(F.max("user_id") + 1).scalar()
        moved = events.where(F.col("event_type") == "purchase").select(
            folio("E", "event_id").alias("tx_id"),
            user_id(F.col("user_id")).alias("cuenta_origen_rfc"),
            user_id((F.col("user_id") * 17 + F.col("event_id") * 7 + 3) % users)
            .alias("cuenta_destino_rfc"),
            F.col("ts").alias("fecha_hora"),
            (money("value") * 1000).cast("decimal(14,2)").alias("monto"),
            F.lit(None).cast("string").alias("referencia_bancaria"),
            F.lit(None).cast("string").alias("cfdi_uuid"))
        return paid.unionByName(moved)

    @cached_property
    def catalog(self) -> DataFrame:
        """Customers of two segments declare a sector."""
        sold = (F.when(F.col("c_mktsegment") == "BUILDING",
                       F.array(F.lit("Servicios de widget"), F.lit("Plate general")))
                .when(F.col("c_mktsegment") == "MACHINERY",
                      F.array(F.lit("Gizmo para otros"), F.lit("gears"))))
        return self._kept(self.raw("customer").select(
            customer_id("c_custkey").alias("rfc"), F.col("c_name").alias("razon_social"),
            F.lower("c_mktsegment").alias("giro"),
            F.array(F.lit("01010101")).alias("claves_esperadas"),
            sold.alias("descripciones_esperadas")).where(
            F.col("descripciones_esperadas").isNotNull()))

    @cached_property
    def leads(self) -> DataFrame:
        """One draft lead per order, of every kind a verdict distinguishes."""
        status = F.col("o_orderstatus")
        scheme = (F.when(F.col("o_orderpriority") == "1-URGENT", "EFOS_69B")
                  .when(F.col("o_orderpriority") == "2-HIGH", "SIN_MATERIALIDAD")
                  .when(F.col("o_orderpriority") == "3-MEDIUM", "INGRESO_NO_DECLARADO")
                  .when(F.col("o_orderpriority") == "5-LOW", "EMPRESA_FACHADA")
                  .when(status == "F", "").when(status == "O", "LAVADO")
                  .otherwise("KICKBACK_CIRCULAR"))
        return self.raw("orders").select(
            F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("lead_id"),
            self._accused(self._small()).alias("rfc_imputado"), scheme.alias("tipo_esquema"),
            F.lit("Artículo 69-B del CFF").alias("regla_fiscal"),
            F.concat(F.lit("Orden "), F.col("o_orderkey").cast("string")).alias("narrativa"))

    @staticmethod
    def _small() -> Column:
        return F.col("o_totalprice") < 30000

    @staticmethod
    def _accused(small: Column) -> Column:
        return F.when(small, F.lit("XXX010101AAA")).otherwise(customer_id("o_custkey"))

    @cached_property
    def evidence(self) -> DataFrame:
        """Each line of the order cites its invoice, or its payment, or something wrong.

        Every other payment also names its invoice, and some items carry a payment's
        identifier where an invoice's belongs.
        """
        pays, foreign, absent = F.col("pays"), F.col("foreign"), F.col("absent")
        both = pays & (F.col("l_linenumber") % 2 == 0)
        wrong = ~pays & ~foreign & F.col("odd")
        own = folio("I", "l_orderkey", "l_suppkey")
        return self._lines.select(
            F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("lead_id"),
            self._accused(F.col("small")).alias("rfc_imputado"),
            F.col("l_linenumber").cast("long").alias("pos"),
            F.when(pays | foreign, fv.TRANSFER_KIND).when(F.col("l_linestatus") == "F",
                                                          fv.INVOICE_KIND).alias("tipo"),
            F.when(both, own).when(~pays & ~foreign & ~wrong, F.when(
                absent, folio("X", "l_orderkey")).otherwise(own)).alias("uuid"),
            F.when(pays | wrong, self.payment_folio(F.col("importe"))).when(
                foreign, folio("E", "l_partkey")).alias("tx_id"))
