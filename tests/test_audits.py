import datetime as dt
import random
from decimal import Decimal

import pytest

from folioscope import schema
from folioscope.functions.mentions import literal_mentions, taxid_mentions
from folioscope.operators import audits
from folioscope.operators.presence import key_map, maybe_among
from pyspark.sql import functions as F

CONFIRMED = "QLM170815T63"


def _texts(spark, *texts):
    return spark.createDataFrame(
        [(str(i), t) for i, t in enumerate(texts)], "answer_id string, text string")


def _cases(spark, *rfcs):
    return spark.createDataFrame([(r,) for r in rfcs], "rfc_imputado string")


def test_mentions_carry_their_surroundings(spark):
    text = f"{CONFIRMED} uno {CONFIRMED.lower()}x dos D{CONFIRMED} fin" + "z" * 300
    rows = taxid_mentions(_texts(spark, text), "answer_id", "text", 20).orderBy("ordinal").collect()
    assert [r["rfc"] for r in rows] == [CONFIRMED, CONFIRMED.lower(), "D" + CONFIRMED, CONFIRMED]
    for r in rows:
        assert r["before"] + r["rfc"] + r["after"] in text
        assert len(r["before"]) <= 20 and len(r["after"]) <= 20
    assert rows[0]["before"] == "" and rows[3]["before"].endswith(" dos D")


@pytest.mark.parametrize("text", [
    f"Dije que no acuse a {CONFIRMED}: faltaban documentos.",
    f"Al final se descarto a {CONFIRMED}, sus pagos cuadran.",
    f"En mayo no se imputo a {CONFIRMED} ni a nadie mas.",
    f"El caso de {CONFIRMED} avanza. Dias despues se descarto a {CONFIRMED.lower()}.",
])
def test_denial_in_the_same_sentence(spark, text):
    assert audits.denied_cases(_texts(spark, text), _cases(spark, CONFIRMED)).count() == 1


@pytest.mark.parametrize("text", [
    f"El caso contra {CONFIRMED} se sostiene con sus facturas.",
    f"{CONFIRMED} tiene dos transferencias que lo prueban.",
    f"Sin leads descartados esta vez; queda imputado {CONFIRMED}.",
    f"No hay mas redes. El caso sigue contra {CONFIRMED}.",
    f"No aparecieron otros nombres: {CONFIRMED} es el unico caso.",
    "No se imputo" + " x" * 80 + f" a {CONFIRMED}",
    "No se imputo a AAA010101AAA.",
])
def test_no_denial(spark, text):
    assert audits.denied_cases(_texts(spark, text), _cases(spark, CONFIRMED)).count() == 0


def _list(spark):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [("DEF010101AAA", "DEFINITIVO", day, Decimal(0)),
         ("PRE010101AAA", "PRESUNTO", day, Decimal(0)),
         ("DES010101AAA", "DESVIRTUADO", day, Decimal(0))], schema.BLACKLIST)


@pytest.mark.parametrize("text,wrong", [
    ("De DEF010101AAA se sabe que es presunta operacion y nada mas.", True),
    ("La lista trae a DEF010101AAA como DEFINITIVO desde enero.", False),
    ("Para la autoridad PRE010101AAA ya es DEFINITIVO.", True),
    ("DEF010101AAA era presunto y ahora es definitivo.", False),
    ("De AAA010101AAA no hay rastro en la lista.", False),
    ("DES010101AAA es presunto.", False),
    ("xDEF010101AAAx es presunto", False),
])
def test_list_status(spark, text, wrong):
    assert (audits.wrong_list_status(_texts(spark, text), _list(spark)).count() == 1) is wrong


def _amounts(spark, extra=()):
    rows = [(CONFIRMED, 2245374.00), (CONFIRMED, 1684780.56), (CONFIRMED, 560593.44),
            ("WTB210404K8A", 1315556.03), ("WTB210404K8A", 647761.09),
            ("WTB210404K8A", 667794.94), *extra]
    return spark.createDataFrame([(r, Decimal(f"{m:.2f}")) for r, m in rows],
                                 "rfc string, monto decimal(24,2)")


def test_swapped_amounts_flag_both_ids(spark):
    text = ("Primero va WTB210404K8A con 2,245,374.00 MXN en facturas; otros 1,315,556.03 MXN "
            f"son del caso que le sigue, el de {CONFIRMED}.")
    rows = audits.swapped_amounts(_texts(spark, text), _amounts(spark)).collect()
    assert {(r["rfc"], r["dueno"]) for r in rows} == {
        ("WTB210404K8A", CONFIRMED), (CONFIRMED, "WTB210404K8A")}


@pytest.mark.parametrize("text,extra", [
    ("Sobre WTB210404K8A pesan $1,315,556.03 MXN en transferencias.", ()),
    ("Nadie supera a NPD090630C47, que suma $1,275,488.33 MXN.",
     (("NPD090630C47", 1275488.33),)),
    ("Una consulta dio $99.99 para WTB210404K8A.", ()),
])
def test_right_amounts_are_silent(spark, text, extra):
    assert audits.swapped_amounts(_texts(spark, text), _amounts(spark, extra)).count() == 0


def test_an_amount_of_many_cases_is_one_row_per_text(spark):
    fee = [(f"{chr(65 + i // 26)}{chr(65 + i % 26)}X010101AA{i % 10}", 580.00) for i in range(300)]
    texts = [f"{CONFIRMED} pago $580.00 de cuota, texto {i}" for i in range(30)]
    amounts = _amounts(spark, fee)
    rows = audits.swapped_amounts(_texts(spark, *texts), amounts).collect()
    assert len(rows) == 30 and {r["n_duenos"] for r in rows} == {len(set(fee))}
    assert {r["dueno"] for r in rows} == {min(fee)[0]}
    assert audits.amount_owners(amounts).where("monto = 580").count() == len(set(fee))


def test_no_cases(spark):
    none = spark.createDataFrame([], "rfc string, monto decimal(24,2)")
    assert audits.swapped_amounts(_texts(spark, "cualquier texto con $100.00"), none).count() == 0


def test_invented_identifiers(spark):
    folio = "0a92940f-03bd-4202-a6cc-54bf9ce20747"
    answers = spark.createDataFrame(
        [("1", f"{folio} y {CONFIRMED} y AAA010101AAA", "y AAA010101AAA?"),
         ("2", f"nada de {CONFIRMED}", None)], "answer_id string, text string, question string")
    seen = spark.createDataFrame([("1", CONFIRMED)], "answer_id string, id string")
    got = {tuple(r) for r in audits.invented_identifiers(answers, seen).collect()}
    assert got == {("1", folio), ("2", CONFIRMED)}


def test_what_a_case_showed_counts_as_seen(spark):
    answers = spark.createDataFrame([("1", "L", f"{CONFIRMED} y NPD090630C47", None)],
                                    "answer_id string, lead_id string, text string, question string")
    shown = spark.createDataFrame([("L", f"RFC {CONFIRMED} - uno")], "lead_id string, texto string")
    seen = audits.seen_identifiers(answers, shown)
    assert [r["id"] for r in audits.invented_identifiers(answers, seen).collect()] == ["NPD090630C47"]


ODD = ["RFC-ROTO-1", "x", "Ñandú S.A. (\\E)", "aXa", "GENERICO"]


def _plain_places(texts, ids, window):
    return sorted((str(i), r, t[max(0, k - window):k], t[k + len(r):k + len(r) + window])
                  for i, t in enumerate(texts) for r in ids
                  for k in range(len(t)) if t.startswith(r, k))


def test_ids_of_any_shape_are_found_as_literals(spark):
    rng = random.Random(3)
    texts = ["", "aXaXa", "RFC-ROTO-1", "RFC-ROTO-", "é" * 4094 + "RFC-ROTO-1 y aXa" + "z" * 5000,
             "y" * 9000 + "Ñandú S.A. (\\E) fin"]
    texts += ["".join(rng.choice("aXx -1R") for _ in range(rng.randrange(300))) for _ in range(20)]
    ids = spark.createDataFrame([(r,) for r in [*ODD, "", "RFC-ROTO-1"]], "rfc string")
    got = literal_mentions(_texts(spark, *texts), "answer_id", "text", ids, 30).collect()
    assert sorted((r["answer_id"], r["rfc"], r["before"], r["after"]) for r in got) == \
        _plain_places(texts, ODD, 30)
    by_place = sorted(got, key=lambda r: r["ordinal"])
    assert [r["before"][-1:] for r in by_place if r["rfc"] == "aXa" and r["answer_id"] == "1"] == [
        "", "X"]
    none = literal_mentions(_texts(spark, "a"), "answer_id", "text", ids.limit(0), 30)
    assert none.count() == 0


def test_odd_ids_are_audited(spark):
    confirmed = _cases(spark, CONFIRMED, " rfc-roto-1 ", "GENERICO", None, "")
    assert {r["rfc"] for r in audits.odd_shaped(confirmed).collect()} == {"rfc-roto-1", "GENERICO"}
    texts = _texts(spark, "Dije que no acuse a RFC-Roto-1: faltaban papeles.",
                   "Sin leads descartados; queda imputado GENERICO.", "No se imputo a GenericO ya.",
                   f"En mayo no se imputo a {CONFIRMED}.", None)
    got = {tuple(r) for r in audits.denied_cases(texts, confirmed).collect()}
    assert got == {("0", "RFC-ROTO-1"), ("2", "GENERICO"), ("3", CONFIRMED)}
    amounts = _amounts(spark, (("RFC-ROTO-1", 10.0), ("GENERICO", 2245374.0)))
    said = _texts(spark, "RFC-ROTO-1 debe $1,315,556.03 MXN y $10.00", "rfc-roto-1 $1,315,556.03",
                  "GENERICO lleva $10.00, no 2,245,374.00", "GENERICO lleva 2,245,374.00")
    rows = audits.swapped_amounts(said, amounts).collect()
    assert {(r["answer_id"], r["rfc"], r["dueno"]) for r in rows} == {
        ("0", "RFC-ROTO-1", "WTB210404K8A"), ("2", "GENERICO", "RFC-ROTO-1")}


def test_the_key_map_loses_no_record_and_passes_few_others(spark):
    records = spark.range(20000).select(
        F.concat(F.lit("id-"), F.col("id")).alias("valor"), F.col("id").alias("_bucket_no"),
        (F.col("id") % 7).alias("x"))
    keys = spark.range(0, 20000, 9).select(F.concat(F.lit("id-"), F.col("id")).alias("k"))
    got = maybe_among(records, key_map(keys, F.col("k")), F.col("valor"))
    assert got.columns == records.columns
    passed = [r["valor"] for r in got.collect()]
    wanted = {f"id-{i}" for i in range(0, 20000, 9)}
    assert wanted <= set(passed) and len(passed) == len(set(passed)) < len(wanted) + 20
    none = key_map(keys.limit(0), F.col("k"))
    assert maybe_among(records, none, F.col("valor")).count() == 0
    fresh = maybe_among(records, key_map(keys, F.col("k")), F.col("valor"))
    plan = fresh._jdf.queryExecution().executedPlan().toString()    # not run, so no second plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 1         # of the map's buckets, not records


def test_every_bit_of_the_map_is_read_as_it_was_drawn(spark):
    """Each key alone: a record with another place in the same bucket does not pass."""
    money = spark.range(300).select((F.col("id") / 4).cast("decimal(24,2)").alias("monto"))
    for i in (0, 1, 7, 8, 299):
        own = F.lit(i / 4).cast("decimal(24,2)")
        got = maybe_among(money, key_map(money.where(F.col("monto") == own), F.col("monto")),
                          F.col("monto"))
        assert [r["monto"] for r in got.collect()] == [Decimal(i * 25) / 100]
    void = spark.createDataFrame([(None,), (Decimal("1.00"),)], "monto decimal(24,2)")
    assert maybe_among(void, key_map(void, F.col("monto")), F.col("monto")).count() == 2


def test_ids_that_share_their_rarest_substring_are_not_tried_in_turn(spark):
    ids = spark.range(400).select(F.format_string("Cliente#%04d", F.col("id")).alias("rfc"))
    texts = _texts(spark, "uno Cliente#0007 y Cliente#0123Cliente#0399.", "Cliente#0007" * 3,
                   "cliente#0007 Cliente#9999 nada")
    found = literal_mentions(texts, "answer_id", "text", ids, 4)
    assert sorted((r.answer_id, r.ordinal, r.rfc, r.before, r.after) for r in found.collect()) == [
        (r.answer_id, at + 1, rfc, r.text[max(at - 4, 0):at], r.text[at + 12:at + 16])
        for r in texts.orderBy("answer_id").collect() for at in range(len(r.text))
        for rfc in [r.text[at:at + 12]]
        if rfc in ("Cliente#0007", "Cliente#0123", "Cliente#0399")]
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()
