import random

from pyspark.sql import functions as F

from folioscope.functions import taxid
from folioscope.operators import similarity


def test_check_character_on_literal_ids(spark):
    cases = {"ADR531130N5A": ("A", True), "XAXX010101004": ("4", True),
             "ADSR51130N5A": ("8", False), "": (None, None), "XXX": (None, None),
             "no-es-un-rfc-12345": (None, None), "ADR531130N5": (None, None),
             " adr531130n5a ": ("A", True)}
    df = spark.createDataFrame([(k,) for k in cases], "rfc string").select(
        "rfc", taxid.check_character(F.col("rfc")), taxid.is_valid_taxid(F.col("rfc")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == cases


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_similarity_join_matches_brute_force(spark):
    chance = random.Random(3)
    known = ["".join(chance.choice("AB01") for _ in range(chance.choice((2, 5, 6, 7))))
             for _ in range(150)]
    read = ["".join(chance.choice("AB01") for _ in range(chance.choice((1, 5, 6, 8))))
            for _ in range(60)]
    known, read = sorted(set(known)), sorted(set(read))
    found = similarity.nearest_known(
        spark.createDataFrame([(r,) for r in read], "rfc string"),
        spark.createDataFrame([(k,) for k in known], "rfc string"), 2).collect()
    expected = {(r, k, _distance(r, k)) for r in read for k in known if _distance(r, k) <= 2}
    assert {tuple(x) for x in found} == expected and len(found) == len(expected)


def test_bounded_distance_above_the_cap(spark):
    row = spark.range(1).select(
        taxid.bounded_distance(F.lit("kitten"), F.lit("sitting"), 2),
        taxid.bounded_distance(F.lit("kitten"), F.lit("sitting"), 3)).first()
    assert tuple(row) == (3, 3)


def test_screening_never_rejects_a_known_id(spark):
    known = spark.createDataFrame([("ADR531130N5A",), ("BAD000000ZZZ",)], "rfc string")
    read = spark.createDataFrame(
        [("adr531130n5a",), ("ADSR51130N5A",), ("BAD000000ZZZ",), ("XAXX010101004",), ("nada",)],
        "rfc string")
    got = {r["rfc"]: r for r in similarity.screen_read_ids(read, known).collect()}
    assert got["ADR531130N5A"]["confiable"] and got["BAD000000ZZZ"]["confiable"]
    assert not got["ADSR51130N5A"]["confiable"]
    assert got["ADSR51130N5A"]["sugerencias"] == "ADR531130N5A"
    assert got["ADSR51130N5A"]["motivo"] == "DIGITO_INCORRECTO"
    assert got["XAXX010101004"]["confiable"]
    assert got["NADA"]["checksum_ok"] is None and not got["NADA"]["confiable"]


def test_exploded_keys_are_not_broadcast(spark):
    """The planner takes a small table's 92 keys an ID for one, so it would broadcast them."""
    ids = spark.range(3000).select(F.concat(F.lit("ABCD"), F.lpad(
        F.col("id").cast("string"), 9, "0")).alias("rfc"))
    found = similarity.nearest_known(ids.where("rfc < 'ABCD000000040'"), ids)
    assert found.count() > 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
