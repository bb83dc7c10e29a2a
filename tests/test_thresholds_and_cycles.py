import random
from decimal import Decimal

import pytest

from folioscope import schema
from folioscope.operators import cycles, ranking, thresholds
from folioscope.settings import Settings


@pytest.mark.parametrize("n", [1, 2, 4, 5, 97])
def test_percentile_is_the_element_at_the_rank(spark, n):
    chance = random.Random(n)
    values = [Decimal(chance.randrange(-10 ** 12, 10 ** 13)).scaleb(-2) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values + [None]], "m decimal(14,2)")
    fractions = (0.0, 0.25, 0.5, 0.75, 1.0)
    expected = [sorted(values)[min(int(f * n), n - 1)] for f in fractions]
    assert thresholds.exact_percentiles(df, "m", fractions) == expected


def test_thresholds_of_an_empty_ledger_are_the_floors(spark):
    empty = spark.createDataFrame([], schema.LEDGER)
    assert thresholds.amount_thresholds(empty) == (Decimal("1000"), Decimal("5000"))


def _brute_force(edges, minimum, max_hops, ratio):
    out = {}
    for (a, b), m in edges.items():
        out.setdefault(a, []).append((b, m))
    found = set()

    def walk(path, legs):
        for b, m in out.get(path[-1], []):
            if b == path[0] and len(path) >= 3:
                every = legs + [m]
                if min(every) >= minimum and min(every) > 0 \
                        and float(max(every)) / float(min(every)) <= ratio:
                    found.add((tuple(path), tuple(every)))
            elif b > path[0] and b not in path and len(path) < max_hops:
                walk(path + [b], legs + [m])
    for node in out:
        walk([node], [])
    return found


def _network(spark, edges):
    return spark.createDataFrame(
        [(a, b, m, 1) for (a, b), m in edges.items()],
        "source string, target string, total_transferido decimal(24,2), "
        "numero_operaciones long")


@pytest.mark.parametrize("seed,ratio,hops", [(1, 1.3, 8), (2, 3.0, 6), (3, 1.05, 5), (4, 1.3, 3)])
def test_cycles_match_brute_force(spark, seed, ratio, hops):
    chance = random.Random(seed)
    nodes = [f"N{i}" for i in range(9)]
    edges = {}
    for _ in range(45):
        a, b = chance.choice(nodes), chance.choice(nodes)
        edges[(a, b)] = Decimal(chance.choice((0, 90, 100, 110, 125, 130, 131, 300))) + \
            Decimal(chance.randrange(100)).scaleb(-2)
    got = cycles.money_cycles(_network(spark, edges), 50, hops, ratio).collect()
    assert len(got) == len({tuple(r["ciclo"]) for r in got})
    assert {(tuple(r["ciclo"]), tuple(r["montos"])) for r in got} == _brute_force(
        edges, 50, hops, ratio)


def test_a_pair_that_trades_both_ways_is_no_cycle(spark):
    edges = {("A", "B"): Decimal(100), ("B", "A"): Decimal(100), ("A", "A"): Decimal(100)}
    assert cycles.money_cycles(_network(spark, edges), 1, 8).count() == 0


def test_empty_network(spark):
    assert cycles.money_cycles(_network(spark, {}), 1, 8).count() == 0


def test_cycle_of_prefers_fewest_nodes_then_smallest_ids(spark):
    m = Decimal(100)
    edges = {p: m for p in [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "A"),
                            ("B", "D")]}
    found = cycles.money_cycles(_network(spark, edges), 1, Settings.max_cycle_nodes)
    ids = spark.createDataFrame([("A",), ("D",), ("Z",)], "rfc string")
    chosen = {r["rfc"]: r["ciclo"] for r in cycles.cycle_of(ids, found).collect()}
    assert chosen == {"A": ["A", "B", "C"], "D": ["A", "B", "D"]}
    legs = cycles.cycle_legs(cycles.cycle_of(ids, found), "rfc").where("rfc = 'D'").collect()
    assert {(r["origen"], r["destino"]) for r in legs} == {("A", "B"), ("B", "D"), ("D", "A")}


def test_numbers_are_consecutive_over_all_partitions(spark):
    df = spark.range(1000).selectExpr("cast(hash(id) as string) as k").distinct()
    rows = ranking.numbered(df, "n", "k").collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(r["k"] for r in rows)
    assert sorted(r["n"] for r in rows) == list(range(1, len(rows) + 1))


def test_halves_out_of_the_ratio_never_meet(spark):
    """Every pair formed lies within the ratio to one fine step, is formed once, and all the
    cycles of the plain join on (band, start, meeting node) are among them."""
    chance, ratio = random.Random(7), 1.3
    nodes = [f"N{i:02d}" for i in range(16)]
    edges = {(a, b): Decimal(round(100 * 1.7 ** chance.random(), 2)).quantize(Decimal("0.01"))
             for a in nodes for b in nodes if a != b and chance.random() < 0.4}
    search = cycles.CycleSearch(_network(spark, edges), 50, 5, ratio)
    some = 0
    for outward, homeward in search._pairs():
        pairs, meet = cycles.formed_pairs(outward, homeward, ratio)
        pairs = pairs.selectExpr(
            "*", "cast(greatest(high, b_high) as double) / cast(least(low, b_low) as double) as r")
        got = pairs.withColumn("hit", meet).selectExpr(
            "nodes", "b_nodes", "band", "start", "r", "hit").collect()
        assert all(r["r"] <= ratio ** (1 + 1 / cycles.FINE_STEPS) * (1 + 1e-6) for r in got)
        assert len(got) == len({(r["band"], r["start"], *r["nodes"], "|", *r["b_nodes"])
                                for r in got})
        out, back, plain = cycles._meeting(outward, homeward, ratio)
        listed = out.join(back, plain).count()
        assert sum(r["hit"] for r in got) == listed
        some += listed
    assert some > 0


def _dense(seed):
    """Equal amounts between almost all pairs of a few nodes, and a long thin ring."""
    chance = random.Random(seed)
    nodes = [f"N{i}" for i in range(7)]
    edges = {(a, b): Decimal(100) for a in nodes for b in nodes
             if a != b and chance.random() < 0.6}
    ring = [f"R{i}" for i in range(6)]
    edges |= {(a, b): Decimal(55) for a, b in zip(ring, ring[1:] + ring[:1])}
    return edges | {("R0", "N0"): Decimal(100), ("Z", "N1"): Decimal(100)}


@pytest.mark.parametrize("seed,hops", [(1, 8), (2, 5), (3, 3)])
def test_membership_and_smallest_cycle_without_listing(spark, seed, hops):
    edges = _dense(seed)
    brute = {(p, legs) for p, legs in _brute_force(edges, 50, hops, 1.3)}
    search = cycles.CycleSearch(_network(spark, edges), 50, hops, 1.3)
    nodes = sorted({n for e in edges for n in e})
    assert {r["rfc"] for r in search.members().collect()} == {n for p, _ in brute for n in p}
    ids = spark.createDataFrame([(n,) for n in nodes], "rfc string")
    best = {n: min(((len(p), p) for p, _ in brute if n in p), default=None) for n in nodes}
    got = {r["rfc"]: (r["num_saltos"], tuple(r["ciclo"])) for r in search.smallest(ids).collect()}
    assert got == {n: b for n, b in best.items() if b}
    large = search.at_least(60)
    assert {r["rfc"] for r in large.members().collect()} == {
        n for p, legs in brute if min(legs) >= 60 for n in p}
