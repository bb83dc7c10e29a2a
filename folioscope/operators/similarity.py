"""I4-I6. Known tax IDs, the nearest ones to a misread ID, and the screening verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.taxid import (bounded_distance, check_character, clean_taxid,
                                        deletion_keys, is_valid_taxid)

_SUGGESTIONS_SHOWN = 3


def known_universe(entities: DataFrame, blacklist: DataFrame) -> DataFrame:
    """I4. Every ID of the audited books or the blacklist."""
    return entities.select("rfc").union(blacklist.select("rfc")).distinct()


def nearest_known(read: DataFrame, known: DataFrame, max_edits: int = 2) -> DataFrame:
    """I5. (leido, sugerido, distancia): all known IDs within `max_edits` of an ID read.

    An equi-join on shared deletion keys, checked by the real distance before the
    pairs are made distinct. `read` and `known` each have a column rfc. An ID has up to 92
    keys, which the planner's sizes do not count, so the join is told to merge: neither
    side may go through the driver.
    """
    probe = (read.select(clean_taxid(F.col("rfc")).alias("leido")).distinct()
             .where(F.col("leido").isNotNull()))
    probe = probe.select("leido", F.explode(deletion_keys(F.col("leido"), max_edits)).alias("k"))
    index = known.select(F.col("rfc").alias("sugerido"),
                         F.explode(deletion_keys(F.col("rfc"), max_edits)).alias("k"))
    distance = bounded_distance(F.col("leido"), F.col("sugerido"), max_edits)
    return (probe.join(index.hint("merge"), "k")
            .withColumn("distancia", distance)
            .where(F.col("distancia") <= max_edits)
            .select("leido", "sugerido", "distancia").distinct())


def suggestions(read: DataFrame, known: DataFrame, max_edits: int = 2) -> DataFrame:
    """I6. (leido, sugerido, distancia): every suggestion for the IDs that are not known."""
    unknown = read.select(clean_taxid(F.col("rfc")).alias("rfc")).join(known, "rfc", "left_anti")
    return nearest_known(unknown, known, max_edits)


def screen_read_ids(read: DataFrame, known: DataFrame, max_edits: int = 2) -> DataFrame:
    """I6. Is an ID read from a document safe to use as a key? It is never rejected.

    Known IDs are trusted; others only with a right check character and nothing
    similar known. One row per distinct ID, with the number of suggestions and the three
    nearest ones for the text; `suggestions` has them all as rows.
    """
    ids = read.select(clean_taxid(F.col("rfc")).alias("rfc")).where("rfc is not null").distinct()
    marked = ids.join(known.select("rfc", F.lit(True).alias("conocido")), "rfc", "left").select(
        "rfc", F.coalesce("conocido", F.lit(False)).alias("conocido"),
        is_valid_taxid(F.col("rfc")).alias("checksum_ok"),
        check_character(F.col("rfc")).alias("digito_esperado"))
    near = nearest_known(marked.where(~F.col("conocido")), known, max_edits)
    nearest_first = Window.partitionBy("leido").orderBy("distancia", "sugerido")
    top = (near.withColumn("puesto", F.row_number().over(nearest_first))
           .groupBy(F.col("leido").alias("rfc"))
           .agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.when(
                   F.col("puesto") <= _SUGGESTIONS_SHOWN, F.struct("puesto", "sugerido")))),
               lambda s: s["sugerido"]), ", ").alias("sugerencias"),
               F.count("*").alias("n_sugerencias")))
    reason = (F.when(F.col("conocido"), "CONOCIDO")
              .when(~F.col("checksum_ok"), "DIGITO_INCORRECTO")
              .when(F.col("checksum_ok").isNull(), "SIN_FORMA_DE_RFC")
              .otherwise("DIGITO_CORRECTO_NO_REGISTRADO"))
    return marked.join(top, "rfc", "left").select(
        "rfc", "conocido", "checksum_ok", "digito_esperado",
        F.coalesce("sugerencias", F.lit("")).alias("sugerencias"),
        F.coalesce("n_sugerencias", F.lit(0)).alias("n_sugerencias"), reason.alias("motivo"),
        (F.col("conocido") | (F.coalesce("checksum_ok", F.lit(False))
                              & F.col("sugerencias").isNull())).alias("confiable"))
