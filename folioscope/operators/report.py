"""R1-R8. Case output as tables.

Documents are tables of lines: (parte, numero, linea, pos, id, texto), whose order
by the first five columns is the document. A case with a million cited rows is a
million lines and never one string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import fixed_values as fv
from folioscope.functions.text import money_text, quoted
from folioscope.operators.blacklist import finally_listed
from folioscope.operators.cycles import CycleSearch, cycle_legs, cycle_of
from folioscope.operators.ranking import numbered

LINE_ORDER = ("parte", "numero", "linea", "pos", "id")
_HEAD, _CONFIRMED, _BETWEEN, _REJECTED, _END = range(5)
_EVIDENCE_LINE = 100
_NAMELESS = "s/n"
_UNTYPED = "sin tipificar"


def _or(column: str, default: str) -> Column:
    return F.when(F.col(column) != "", F.col(column)).otherwise(F.lit(default))


def _amount_or(column: str, default: str) -> Column:
    return F.coalesce(money_text(F.col(column)), F.lit(default))


def _fixed_lines(spark: SparkSession, part: int, texts) -> DataFrame:
    return spark.createDataFrame(
        [(part, 0, i, 0, "", t) for i, t in enumerate(texts)],
        "parte int, numero long, linea int, pos long, id string, texto string")


def _case_lines(cases: DataFrame, part: int, lines: dict[int, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("linea"), t.alias("texto"))
                     for n, t in lines.items()])
    return cases.select(
        F.lit(part).alias("parte"), "numero", F.explode(rows).alias("r")).select(
        "parte", "numero", "r.linea", F.lit(0).cast("long").alias("pos"), F.lit("").alias("id"),
        "r.texto")


def _evidence_lines(cases: DataFrame, resolved: DataFrame, text: Column,
                    line: int = _EVIDENCE_LINE) -> DataFrame:
    return resolved.join(cases.select("lead_id", "numero"), "lead_id").select(
        F.lit(_CONFIRMED).alias("parte"), "numero", F.lit(line).alias("linea"),
        F.col("pos").cast("long").alias("pos"), "id", text.alias("texto"))


def _split_cases(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(confirmed, rejected), each numbered in the order of the accused ID."""
    confirmed = numbered(verdicts.where("confirmado"), "numero", "rfc_imputado", "lead_id")
    rejected = numbered(verdicts.where(~F.col("confirmado")), "numero", "rfc_imputado", "lead_id")
    return confirmed, rejected


def case_document(verdicts: DataFrame, resolved: DataFrame, generated_at: str) -> DataFrame:
    """R1. The case document in Markdown: a section per confirmed lead, a line per rejected."""
    spark = verdicts.sparkSession
    confirmed, rejected = _split_cases(verdicts)
    n_yes, n_no = confirmed.count(), rejected.count()
    if n_yes + n_no == 0:
        return _fixed_lines(spark, _HEAD, [
            "# Expediente Forense de Fraude Fiscal", "",
            "No se investigó ningún RFC en esta corrida."])
    head = [
        "# Expediente Forense de Fraude Fiscal", "", f"_Generado el {generated_at}._", "",
        "> Redactado con plantilla determinista a partir de los registros verificados.", "",
        f"**Casos confirmados con prueba:** {n_yes}  ",
        f"**Leads descartados por falta de evidencia:** {n_no}", "", "---", "",
        "## Casos confirmados", ""]
    if not n_yes:
        head += ["_Ninguno._", ""]
    between = ["---", "", "## Leads descartados", ""]
    if not n_no:
        between += ["_Ninguno._", ""]
    empty = F.lit("")
    section = _case_lines(confirmed, _CONFIRMED, {
        0: F.concat(F.lit("### "), F.col("numero").cast("string"), F.lit(". "),
                    F.col("rfc_imputado"), F.lit(" — "), _or("razon_social", _NAMELESS)),
        1: empty,
        2: F.concat(F.lit("- **Tipología:** "), F.col("tipo_esquema")),
        3: F.concat(F.lit("- **Monto total acreditado:** "),
                    money_text(F.col("monto_total_evidencia"))),
        4: F.concat(F.lit("- **Regla fiscal violada:** "), _or("regla_fiscal", "N/A")),
        5: empty, 6: _or("narrativa", ""), 7: empty,
        8: F.lit("**Cadena de evidencia**"), 9: empty,
        10: F.lit("| Tipo | Identificador | Monto | Suma al total |"),
        11: F.lit("|---|---|---|---|"),
        _EVIDENCE_LINE + 1: empty})
    rows = _evidence_lines(confirmed, resolved, F.concat(
        F.lit("| "), F.col("tipo"), F.lit(" | `"), F.col("id"), F.lit("` | "),
        _amount_or("monto", fv.DASH), F.lit(" | "),
        F.when(F.col("contado_en_total"), "sí").otherwise("no (respaldo)"), F.lit(" |")))
    dropped = _case_lines(rejected, _REJECTED, {0: F.concat(
        F.lit("- **"), F.coalesce("rfc_imputado", F.lit("None")), F.lit("** (tentativa: "),
        _or("tipo_esquema", _UNTYPED), F.lit(") — "), F.col("razon"))})
    return reduce(DataFrame.unionByName, [
        _fixed_lines(spark, _HEAD, head), section, rows,
        _fixed_lines(spark, _BETWEEN, between), dropped, _fixed_lines(spark, _END, [""])])


def case_context(verdicts: DataFrame, resolved: DataFrame) -> DataFrame:
    """R2. The same cases as plain text, with the parties of each cited row."""
    spark = verdicts.sparkSession
    confirmed, rejected = _split_cases(verdicts)
    head = ["=== CASOS CONFIRMADOS ==="] + (["(ninguno)"] if confirmed.isEmpty() else [])
    between = ["", "=== LEADS DESCARTADOS (revisados y NO imputados) ==="] + (
        ["(ninguno)"] if rejected.isEmpty() else [])
    section = _case_lines(confirmed, _CONFIRMED, {
        0: F.lit(""),
        1: F.concat(F.lit("RFC "), F.col("rfc_imputado"), F.lit(" — "),
                    _or("razon_social", _NAMELESS)),
        2: F.concat(F.lit("  esquema: "), F.col("tipo_esquema")),
        3: F.concat(F.lit("  monto acreditado: "), money_text(F.col("monto_total_evidencia")),
                    F.lit(" MXN")),
        4: F.concat(F.lit("  regla violada: "), _or("regla_fiscal", "no especificada")),
        5: F.concat(F.lit("  hechos: "), _or("narrativa", "sin narrativa"))})
    parties = F.when(F.col("de_rfc").isNotNull(), F.concat(
        F.lit(", de "), F.col("de_rfc"), F.lit(" a "), F.col("a_rfc"))).otherwise("")
    rows = _evidence_lines(confirmed, resolved, F.concat(
        F.lit("    - "), F.col("tipo"), F.lit(" "), F.col("id"), F.lit(" por "),
        _amount_or("monto", "?"), parties, F.lit(" ("),
        F.when(F.col("contado_en_total"), "suma al total").otherwise("respaldo, no suma"),
        F.lit(")")))
    dropped = _case_lines(rejected, _REJECTED, {
        0: F.concat(F.lit("  - RFC "), F.coalesce("rfc_imputado", F.lit("None")),
                    F.lit(" (tentativa: "), _or("tipo_esquema", _UNTYPED), F.lit(")")),
        1: F.concat(F.lit("    razón del descarte: "), F.col("razon"))})
    return reduce(DataFrame.unionByName, [
        _fixed_lines(spark, _HEAD, head), section, rows,
        _fixed_lines(spark, _BETWEEN, between), dropped])


def write_document(lines: DataFrame, path: str, *order: str) -> None:
    """Write a document as ordered text parts (a range-partitioned sort)."""
    lines.orderBy(*(order or LINE_ORDER)).select("texto").write.mode("overwrite").text(path)


def run_summary(verdicts: DataFrame) -> DataFrame:
    """R3. Confirmed and rejected leads and the proven total."""
    return verdicts.agg(
        F.count_if("confirmado").alias("n_confirmados"),
        F.count_if(~F.col("confirmado")).alias("n_descartados"),
        F.coalesce(F.sum(F.when(F.col("confirmado"), F.col("monto_total_evidencia"))), F.lit(0))
        .cast("decimal(24,2)").alias("monto_acreditado"))


def money_trail(cases: DataFrame, resolved: DataFrame, cycles: DataFrame | CycleSearch,
                blacklist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """R4. (edges, nodes) of each case's money trail.

    Edges are the existing cited rows with both parties; a circular case also gets
    the legs of its cycle that no cited row covers. A case without edges has no trail.
    """
    case_ids = cases.select("lead_id")
    label = F.concat(F.when(F.col("tipo") == fv.INVOICE_KIND, "CFDI  ")
                     .otherwise("transferencia  "), _amount_or("monto", ""))
    cited = (resolved.where(F.col("existe") & (F.col("de_rfc") != "") & (F.col("a_rfc") != ""))
             .join(case_ids, "lead_id", "left_semi")
             .select("lead_id", F.lit(0).alias("grupo"), F.col("pos").cast("long").alias("pos"),
                     "id", "de_rfc", "a_rfc", label.alias("etiqueta"),
                     F.lit(False).alias("es_ciclo")))
    circular = cases.where(F.col("tipo_esquema") == "KICKBACK_CIRCULAR").select(
        "lead_id", F.col("rfc_imputado").alias("rfc"))
    legs = cycle_legs(circular.join(cycle_of(circular, cycles), "rfc"), "lead_id").select(
        "lead_id", F.lit(1).alias("grupo"), F.col("tramo").cast("long").alias("pos"),
        F.lit("").alias("id"), F.col("origen").alias("de_rfc"), F.col("destino").alias("a_rfc"),
        money_text(F.col("monto")).alias("etiqueta"), F.lit(True).alias("es_ciclo"))
    covered = cited.select("lead_id", "de_rfc", "a_rfc").distinct()
    edges = cited.unionByName(legs.join(covered, ["lead_id", "de_rfc", "a_rfc"], "left_anti"))

    ends = edges.select("lead_id", F.explode(F.array("de_rfc", "a_rfc")).alias("rfc"))
    accused = cases.select("lead_id", F.col("rfc_imputado").alias("rfc"), "razon_social")
    drawn = edges.select("lead_id").distinct()
    members = ends.union(accused.join(drawn, "lead_id", "left_semi").select("lead_id", "rfc"))
    listed = finally_listed(blacklist).withColumn("_listed", F.lit(True))
    nodes = (members.distinct().join(listed, "rfc", "left")
             .join(accused.withColumn("_accused", F.lit(True)), ["lead_id", "rfc"], "left")
             .select("lead_id", "rfc",
                     F.when(F.col("_accused"), "IMPUTADO").when(F.col("_listed"), "LISTADO")
                     .otherwise("OTRO").alias("papel"),
                     F.when(F.col("_accused"), F.coalesce("razon_social", F.lit("")))
                     .otherwise("").alias("razon_social")))
    return edges, nodes


def trail_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """R5. DOT lines per case: (lead_id, parte, grupo, pos, id, texto), nodes in order."""
    head = [
        "digraph rastro {",
        '  rankdir=LR; bgcolor="transparent";',
        '  node [shape=box style="rounded,filled" fontname="Helvetica" fontsize=10 penwidth=0 '
        'margin="0.18,0.10"];',
        '  edge [fontname="Helvetica" fontsize=9 color="#94A3B8" penwidth=1.3];']
    drawn = edges.select("lead_id").distinct()
    frame = F.array(*[F.struct(F.lit(0).alias("parte"), F.lit(i).cast("long").alias("pos"),
                               F.lit(t).alias("texto")) for i, t in enumerate(head)],
                    F.struct(F.lit(3).alias("parte"), F.lit(0).cast("long").alias("pos"),
                             F.lit("}").alias("texto")))
    framing = drawn.select("lead_id", F.explode(frame).alias("f")).select(
        "lead_id", "f.parte", F.lit(0).alias("grupo"), "f.pos", F.lit("").alias("id"), "f.texto")

    def box(label: Column, fill: str, ink: str) -> Column:
        return F.concat(F.lit('  "'), quoted(F.col("rfc")), F.lit('" [label="'), label,
                        F.lit(f'" fillcolor="{fill}" fontcolor="{ink}"];'))

    rfc = quoted(F.col("rfc"))
    named = F.when(F.col("razon_social") != "",
                   F.concat(rfc, F.lit("\\n"), quoted(F.col("razon_social")))).otherwise(rfc)
    boxes = nodes.select(
        "lead_id", F.lit(1).alias("parte"), F.lit(0).alias("grupo"),
        F.lit(0).cast("long").alias("pos"), F.col("rfc").alias("id"),
        F.when(F.col("papel") == "IMPUTADO", box(named, fv.COLOR_ACCUSED, "white"))
        .when(F.col("papel") == "LISTADO",
              box(F.concat(rfc, F.lit("\\n69-B DEFINITIVO")), fv.COLOR_LISTED, "white"))
        .otherwise(box(rfc, fv.COLOR_OTHER, fv.COLOR_OTHER_TEXT)).alias("texto"))
    style = F.when(F.col("es_ciclo"), f'color="{fv.COLOR_ACCUSED}" penwidth=2.0').otherwise(
        f'color="{fv.COLOR_EDGE}"')
    arrows = edges.select(
        "lead_id", F.lit(2).alias("parte"), "grupo", "pos", "id",
        F.concat(F.lit('  "'), quoted(F.col("de_rfc")), F.lit('" -> "'), quoted(F.col("a_rfc")),
                 F.lit('" [label="  '), quoted(F.col("etiqueta")), F.lit('" '), style,
                 F.lit("];")).alias("texto"))
    return framing.unionByName(boxes).unionByName(arrows)


def legend(scheme: Column) -> Column:
    """R6. One line on what a scheme's trail shows."""
    known = F.create_map(*[F.lit(x) for pair in fv.LEGENDS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, scheme), F.lit(fv.LEGEND_DEFAULT))


def evidence_rows(resolved: DataFrame) -> DataFrame:
    """R7. Evidence as shown: instrument, identifier, parties, amount, how it counts."""
    return resolved.select(
        "lead_id", "pos", F.coalesce("tipo", F.lit(fv.DASH)).alias("instrumento"),
        _or("id", fv.DASH).alias("identificador"), _or("de_rfc", fv.DASH).alias("de"),
        _or("a_rfc", fv.DASH).alias("a"), _amount_or("monto", fv.DASH).alias("monto"),
        F.when(F.col("contado_en_total"), fv.COUNTS_LABEL).otherwise(fv.BACKS_LABEL)
        .alias("computo"))


def case_summary(verdicts: DataFrame) -> DataFrame:
    """R8. Confirmed cases with their amount, and under TOTAL the sum of all."""
    confirmed = numbered(verdicts.where("confirmado"), "numero", "rfc_imputado", "lead_id")
    rows = confirmed.select(
        "numero", _or("rfc_imputado", "-").alias("rfc"), _or("razon_social", "-").alias("nombre"),
        _or("tipo_esquema", "-").alias("esquema"),
        money_text(F.col("monto_total_evidencia")).alias("monto"))
    total = confirmed.agg(
        F.coalesce(F.sum("monto_total_evidencia"), F.lit(0)).alias("t")).select(
        F.lit(None).cast("long").alias("numero"), F.lit("TOTAL").alias("rfc"),
        F.lit("").alias("nombre"), F.lit("").alias("esquema"),
        money_text(F.col("t")).alias("monto"))
    return rows.unionByName(total)
