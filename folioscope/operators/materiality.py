"""M2-M4. Does an invoiced concept fit the business of the company that received it?

A profile word has no white space in it, so it occurs in a concept exactly when it
occurs inside one of the concept's words. Each distinct word of a company's concepts is
cut into its parts of the lengths that the company's profile words have, and those are
looked up by equality: concepts and profile words are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.folios import packed, unpacked
from folioscope.functions.text import contains_any, fold
from folioscope.operators.presence import key_map, maybe_among
from folioscope.session import settle
from folioscope.settings import Settings

_SHORTEST_WORD = 5
_SAMPLE = 3
_INFERRED = "inferido de su propio historial de facturación"
_ITEM_TYPE = ("struct<sin_falla:boolean,fila:bigint,concepto:string,match:boolean,"
              "motivo:string>")


def issued_descriptions(invoices: DataFrame, items: DataFrame,
                        max_descriptions: int | None = None) -> DataFrame:
    """M2a. (rfc, descripcion): what each company sells, by its own invoices."""
    texts = items.where(F.col("descripcion") != "").select(
        packed(F.col("invoice_uuid")).alias("_key"), "descripcion")
    issued = (texts.join(invoices.select(packed(F.col("uuid")).alias("_key"),
                                         F.col("emisor_rfc").alias("rfc")), "_key")
              .select("rfc", "descripcion").distinct())
    if max_descriptions is None:
        return issued
    in_order = Window.partitionBy("rfc").orderBy("descripcion")
    return (issued.withColumn("_n", F.row_number().over(in_order))
            .where(F.col("_n") <= max_descriptions).drop("_n"))


def profiles(rfcs: DataFrame, catalog: DataFrame, invoices: DataFrame, items: DataFrame,
             entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2b. ((rfc, fuente, razon_social, giro), (rfc, descripcion)) of the given companies.

    The declared catalog comes first, then the company's own issuing history; a
    company with neither has no profile. Items are only read for the invoices of
    companies that need their history.
    """
    wanted = rfcs.select("rfc").distinct()
    declared = (catalog.join(wanted, "rfc", "left_semi")
                .select("rfc", F.lit("CATALOGO").alias("fuente"), "razon_social", "giro",
                        "descripciones_esperadas"))
    undeclared = wanted.join(catalog.select("rfc"), "rfc", "left_anti")
    # Invoices are only cut down where they are read; the companies are looked up exactly once
    # each of their descriptions is one row.
    theirs = maybe_among(invoices.select("uuid", "emisor_rfc"),
                         key_map(undeclared, F.col("rfc")), F.col("emisor_rfc"))
    own = settle(issued_descriptions(theirs, items).join(undeclared, "rfc", "left_semi"))
    inferred = (own.select("rfc").distinct()
                .join(entities.select("rfc", F.col("razon_social").alias("_name")), "rfc", "left")
                .select("rfc", F.lit("HISTORIAL").alias("fuente"),
                        F.coalesce("_name", "rfc").alias("razon_social"),
                        F.lit(_INFERRED).alias("giro")))
    heads = declared.drop("descripciones_esperadas").unionByName(inferred)
    texts = declared.select(
        "rfc", F.explode("descripciones_esperadas").alias("descripcion")
    ).distinct().unionByName(own.select("rfc", "descripcion"))     # distinct, of other companies
    return heads, texts


def profile_words(descriptions: DataFrame, stop_words=Settings.profile_stop_words) -> DataFrame:
    """M2c. (rfc, palabra): words longer than four letters that are not stop words."""
    return (descriptions
            .select("rfc", F.explode(F.split(fold(F.col("descripcion")), r"(?U)\s+"))
                    .alias("palabra"))
            .where((F.length("palabra") >= _SHORTEST_WORD) & ~F.col("palabra").isin(*stop_words))
            .distinct())


def _fits(concepts: DataFrame, words: DataFrame) -> DataFrame:
    """(rfc, concepto) pairs that contain a profile word of the same company."""
    tokens = (concepts.select("rfc", "concepto", F.explode(F.array_distinct(
        F.split("normal", r"(?U)\s+"))).alias("token"))
        .where(F.length("token") >= _SHORTEST_WORD))
    lengths = words.groupBy("rfc").agg(F.collect_set(F.length("palabra")).alias("largos"))
    parts = (tokens.select("rfc", "token").distinct().join(lengths, "rfc")
             .select("rfc", "token", F.explode(F.filter(
                 "largos", lambda n: n <= F.length("token"))).alias("largo"))
             .select("rfc", "token", F.explode(F.transform(
                 F.sequence(F.lit(1), F.length("token") - F.col("largo") + 1),
                 lambda i: F.substring("token", i, F.col("largo")))).alias("palabra")))
    found = parts.join(words, ["rfc", "palabra"], "left_semi").select("rfc", "token").distinct()
    return tokens.join(found, ["rfc", "token"], "left_semi").select("rfc", "concepto").distinct()


def _concepts(pairs: DataFrame, generic_terms) -> DataFrame:
    normal = fold(F.col("concepto"))
    return (pairs.select("rfc", "concepto").where(F.col("concepto").isNotNull()).distinct()
            .withColumn("normal", normal)
            .withColumn("generico", contains_any(F.col("normal"), generic_terms)))


def failing_concepts(pairs: DataFrame, heads: DataFrame, words: DataFrame,
                     generic_terms=Settings.generic_terms) -> DataFrame:
    """The (rfc, concepto) pairs whose verdict is false, without working out the others.

    Only a generic concept can fail, and that needs no join, so it is filtered first.
    """
    generic = _concepts(pairs, generic_terms).where("generico")
    return (generic.join(heads.select("rfc"), "rfc", "left_semi")
            .join(_fits(generic, words), ["rfc", "concepto"], "left_anti")
            .select("rfc", "concepto"))


def _sample(descriptions: DataFrame) -> DataFrame:
    """The first three descriptions of each company, in order."""
    in_order = Window.partitionBy("rfc").orderBy("descripcion")
    return (descriptions.withColumn("_n", F.row_number().over(in_order))
            .where(F.col("_n") <= _SAMPLE)
            .groupBy("rfc")
            .agg(F.array_join(F.array_sort(F.collect_list("descripcion")), ", ")
                 .alias("muestra")))


def concept_verdicts(pairs: DataFrame, heads: DataFrame, descriptions: DataFrame,
                     settings: Settings = Settings()) -> DataFrame:
    """M3. (rfc, concepto, corresponde, generico, match, motivo) for distinct pairs.

    match is null without a profile, false for a generic concept foreign to the
    profile, true otherwise.
    """
    concepts = _concepts(pairs, settings.generic_terms)
    words = profile_words(descriptions, settings.profile_stop_words)
    known = heads.join(_sample(descriptions), "rfc", "left")
    fits = _fits(concepts, words).withColumn("corresponde", F.lit(True))
    joined = (concepts.join(fits, ["rfc", "concepto"], "left")
              .join(known, "rfc", "left")
              .withColumn("corresponde", F.coalesce("corresponde", F.lit(False))))
    no_profile = F.col("giro").isNull()
    match = F.when(~no_profile, F.col("corresponde") | ~F.col("generico"))
    reason = (
        F.when(no_profile, F.format_string(
            "%s no tiene giro declarado ni facturas emitidas con las que contrastar el concepto.",
            F.col("rfc")))
        .when(F.col("corresponde"), F.format_string(
            "El concepto corresponde al giro (%s).", F.col("giro")))
        .when(~F.col("generico"), F.format_string(
            "El concepto ('%s') es ajeno al giro de %s (%s), pero es un servicio específico.",
            F.col("concepto"), F.col("razon_social"), F.col("giro")))
        .otherwise(F.format_string(
            "El concepto ('%s') es genérico y ajeno al giro de %s (%s: %s).",
            F.col("concepto"), F.col("razon_social"), F.col("giro"),
            F.coalesce("muestra", F.lit("")))))
    return joined.select("rfc", "concepto",
                         F.when(~no_profile, F.col("corresponde")).alias("corresponde"),
                         "generico", match.alias("match"), reason.alias("motivo"))


def received_concepts(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """(uuid, rfc, fila, concepto): each item of an invoice, against its receiver."""
    return items.select(
        packed(F.col("invoice_uuid")).alias("_key"), F.col("_row").alias("fila"),
        F.col("descripcion").alias("concepto")
    ).join(invoices.select(packed(F.col("uuid")).alias("_key"),
                           F.col("receptor_rfc").alias("rfc")), "_key").select(
        unpacked(F.col("_key")).alias("uuid"), "rfc", "fila", "concepto")


def _verdict_order(match: Column) -> Column:
    return F.coalesce(match, F.lit(True))


def invoice_verdicts(invoices: DataFrame, received: DataFrame, verdicts: DataFrame,
                     reasons: bool = True) -> DataFrame:
    """M4. (uuid, rfc, match, concepto, motivo): the first failing item, else the first item.

    Without `reasons` no motivo comes out, nor is the sentence shuffled with every item.
    """
    said = ["motivo"] if reasons else []
    keyed = received.select(packed(F.col("uuid")).alias("_key"), "rfc", "fila", "concepto")
    item = keyed.join(verdicts.select("rfc", "concepto", "match", *said), ["rfc", "concepto"])
    first = item.groupBy("_key").agg(F.min(F.struct(
        _verdict_order(F.col("match")).alias("sin_falla"), "fila", "concepto", "match",
        *(said or [F.lit(None).alias("motivo")])).cast(_ITEM_TYPE)).alias("v"))
    judged = invoices.select(packed(F.col("uuid")).alias("_key"),
                             F.col("receptor_rfc").alias("rfc")).join(first, "_key", "left").select(
        unpacked(F.col("_key")).alias("uuid"), "rfc", F.col("v.match").alias("match"),
        F.col("v.concepto").alias("concepto"),
        F.coalesce("v.motivo", F.lit("La factura no tiene ninguna partida.")).alias("motivo"))
    return judged if reasons else judged.drop("motivo")


def immaterial_invoices(invoices: DataFrame, items: DataFrame, catalog: DataFrame,
                        entities: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(uuid, rfc): invoices with a failing item, by their receiver. What E6 and E9 need of M4.

    Items are cut down to generic concepts before anything is joined.
    """
    generic_items = items.where(
        contains_any(fold(F.col("descripcion")), settings.generic_terms))
    drawn = key_map(generic_items, F.col("invoice_uuid"))
    theirs = maybe_among(invoices.select("uuid", "receptor_rfc"), drawn, F.col("uuid"))
    received = settle(received_concepts(theirs, generic_items).select(
        packed(F.col("uuid")).alias("_key"), "rfc", "concepto"))
    pairs = received.select("rfc", "concepto").distinct()
    heads, texts = profiles(pairs, catalog, invoices, items, entities)
    failing = failing_concepts(
        pairs, heads, profile_words(texts, settings.profile_stop_words), settings.generic_terms)
    return received.join(failing, ["rfc", "concepto"], "left_semi").select(
        "_key", "rfc").distinct().select(unpacked(F.col("_key")).alias("uuid"), "rfc")
