"""G1, G2. Money that returns to where it started, in similar amounts.

Enumeration works on distributed path tables with three properties that keep the
tables small on a large network:

* Bands. All legs of a reported cycle lie within `max_ratio` of the smallest one.
  Amounts are put on a logarithmic scale whose step is that ratio, so a cycle only
  uses edges of two neighbouring steps. Paths grow inside one band: the join key
  is (band, node), and an edge is never paired with one of a different size.
* Orientation. A cycle is found from its best connected node only, and every other
  node must be less connected. A hub is thus a start or an end, never a way
  through, which would pair all its incoming with all its outgoing edges.
* Two halves. A cycle of n nodes is a forward path of ceil(n/2) legs and a backward
  path of floor(n/2) legs that meet, joined on (band, start, meeting node). Eight
  nodes need paths of four legs, not of eight. To list them, a band is cut into fine
  steps, and a half only meets halves whose legs lie within the ratio of the smallest
  leg of both, to a fine step; the exact ratio and disjoint nodes are left to test.

Only G1 lists cycles. Whether an ID is in one (D3, E5) is answered by two semi-joins
of the halves, so the output is bounded by the half paths and not by their pairs. One
cycle per ID (G2) goes up by length and lists only cycles with an ID that has none yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.presence import among, key_map, maybe_among
from folioscope.session import settle
from folioscope.settings import Settings


def between_payers(ledger: DataFrame) -> DataFrame:
    """The transfers that may be part of a cycle: payer and payee differ, and both may be found
    on the other side of a transfer too. The rest is left out before anything is summed.

    They are compared together with the last look at the map: on its own the planner would
    compare them where they are read, and make both IDs once more for it.
    """
    payer, payee = F.col("cuenta_origen_rfc"), F.col("cuenta_destino_rfc")
    sides = key_map(ledger.select(F.explode(F.array(
        F.struct(F.lit("paga").alias("lado"), payer.alias("rfc")),
        F.struct(F.lit("cobra").alias("lado"), payee.alias("rfc")))).alias("e")).select("e.*"),
        F.col("lado"), F.col("rfc"))
    paid_too = maybe_among(ledger, sides, F.lit("cobra"), payer)
    return among(paid_too, sides, "_may", F.lit("paga"), payee).where(
        F.when(payer != payee, F.col("_may"))).drop("_may")


def _edges(network: DataFrame, min_amount) -> DataFrame:
    """Edges large enough, between nodes that both pay and are paid."""
    # One test of the sum, so it stays above it: payer and payee alone would be compared for
    # every transfer, which makes both IDs once more.
    amount = F.when(F.col("source") != F.col("target"), F.col("total_transferido"))
    # Read three times below, so the network is summed once.
    edges = settle(network.where((amount > 0) & (amount >= F.lit(min_amount))).select(
        "source", "target", F.col("total_transferido").cast("decimal(38,2)").alias("m")))
    through = edges.select(F.col("source").alias("node")).distinct().join(
        edges.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
    for end in ("source", "target"):
        edges = edges.join(through.select(F.col("node").alias(end)), end, "left_semi")
    return edges


FINE_STEPS = 4          # a band's width, which is the ratio, in steps of its own


def _fine_step(amount: str, max_ratio: float) -> Column:
    step = max(math.log(max_ratio), 1e-9) * (1 + 1e-9) / FINE_STEPS
    return F.floor(F.log(F.col(amount).cast("double")) / F.lit(step))


def _banded(edges: DataFrame, max_ratio: float) -> DataFrame:
    level = F.floor(_fine_step("m", max_ratio) / FINE_STEPS)
    return (edges.withColumn("level", level)
            .select("*", F.explode(F.array("level", F.col("level") - 1)).alias("band"))
            .withColumn("smallest_step", F.col("level") == F.col("band"))
            .drop("level"))


def _connected(edges: DataFrame) -> DataFrame:
    """Edges whose two ends both have a way in and a way out, with each end's degree."""
    ends = edges.select(
        "band",
        F.explode(F.array(
            F.struct(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")),
            F.struct(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")),
        )).alias("end")).select("band", "end.*")
    alive = (ends.groupBy("band", "node")
             .agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
             .where((F.col("out") > 0) & (F.col("in") > 0))
             .select("band", "node", (F.col("out") + F.col("in")).alias("degree")))
    source = alive.select("band", F.col("node").alias("source"),
                          F.col("degree").alias("source_degree"))
    target = alive.select("band", F.col("node").alias("target"),
                          F.col("degree").alias("target_degree"))
    bare = edges.drop("source_degree", "target_degree")
    return bare.join(source, ["band", "source"]).join(target, ["band", "target"])


def _below(degree: str, node: str, top_degree: str, top: str) -> Column:
    return F.struct(F.col(degree), F.col(node)) < F.struct(F.col(top_degree), F.col(top))


def _similar(smallest: Column, largest: Column, max_ratio: float) -> Column:
    return largest.cast("double") <= smallest.cast("double") * F.lit(max_ratio * (1 + 1e-9))


def _grow(paths: DataFrame, edges: DataFrame, max_ratio: float, forward: bool) -> DataFrame:
    """One more leg at the open end of each path."""
    at, to, to_degree = (("source", "target", "target_degree") if forward
                         else ("target", "source", "source_degree"))
    leg = edges.select(
        "band", F.col(at).alias("open"), F.col(to).alias("node"),
        F.col(to_degree).alias("node_degree"), F.col("m").alias("leg"),
        F.col("smallest_step").alias("leg_smallest_step"))
    low, high = F.least("low", "leg"), F.greatest("high", "leg")
    joined = paths.join(leg, ["band", "open"]).where(
        _below("node_degree", "node", "start_degree", "start")
        & ~F.array_contains(F.col("nodes"), F.col("node"))
        & _similar(low, high, max_ratio))
    node, leg_array = F.array("node"), F.array("leg")
    return joined.select(
        "band", "start", "start_degree", F.col("node").alias("open"),
        (F.concat("nodes", node) if forward else F.concat(node, "nodes")).alias("nodes"),
        (F.concat("legs", leg_array) if forward else F.concat(leg_array, "legs")).alias("legs"),
        low.alias("low"), high.alias("high"),
        (F.col("smallest_step") | F.col("leg_smallest_step")).alias("smallest_step"))


def _first_legs(edges: DataFrame, forward: bool) -> DataFrame:
    """Paths of one leg out of (or into) a node that outranks the other end."""
    start, other = ("source", "target") if forward else ("target", "source")
    return edges.where(
        _below(other + "_degree", other, start + "_degree", start)
    ).select(
        "band", F.col(start).alias("start"), F.col(start + "_degree").alias("start_degree"),
        F.col(other).alias("open"), F.array(other).alias("nodes"), F.array("m").alias("legs"),
        F.col("m").alias("low"), F.col("m").alias("high"), "smallest_step")


def _meeting(outward: DataFrame, homeward: DataFrame,
             max_ratio: float) -> tuple[DataFrame, DataFrame, Column]:
    """Both sorts of halves under names of their own, and when two of them are a cycle."""
    back = homeward.select(*[F.col(c).alias(f"b_{c}") for c in homeward.columns])
    low, high = F.least("low", "b_low"), F.greatest("high", "b_high")
    meet = ((F.col("band") == F.col("b_band")) & (F.col("start") == F.col("b_start"))
            & (F.col("open") == F.col("b_open"))
            # The band of a cycle is the step of its smallest leg, so it counts once.
            & (F.col("smallest_step") | F.col("b_smallest_step"))
            & (high.cast("double") / low.cast("double") <= F.lit(max_ratio))
            & ~F.arrays_overlap(F.col("nodes"), F.slice("b_nodes", F.lit(2), F.size("b_nodes"))))
    return outward, back, meet


def _below_reach(halves: DataFrame, max_ratio: float, prefix: str, below: bool) -> DataFrame:
    """A copy of each half for every fine step (`_reach`) that the smallest leg of a cycle may
    have if it lies in the other half: no higher than this half's own smallest leg (`below`:
    lower), not out of the ratio of its largest, and inside the band."""
    own = _fine_step(f"{prefix}low", max_ratio) - int(below)
    floor = F.col(f"{prefix}band") * FINE_STEPS
    first = F.greatest(_fine_step(f"{prefix}high", max_ratio) - FINE_STEPS, floor)
    last = F.least(own, floor + (FINE_STEPS - 1))
    return halves.withColumn("_reach", F.explode(F.when(
        first <= last, F.sequence(first, last))))


def formed_pairs(outward: DataFrame, homeward: DataFrame,
                 max_ratio: float) -> tuple[DataFrame, Column]:
    """The pairs of halves whose keys meet, each once, and the test they still have to pass.

    Either the forward half holds the smallest step of the pair, or the backward half holds a
    step below all of the forward one's. Whichever holds it stays as it is, and the other half
    is copied to the steps within its reach.
    """
    outward, back, meet = _meeting(outward, homeward, max_ratio)
    keys = ((F.col("band") == F.col("b_band")) & (F.col("start") == F.col("b_start"))
            & (F.col("open") == F.col("b_open")))
    forward_low = outward.where("smallest_step").withColumn(
        "_step", _fine_step("low", max_ratio)).join(
        _below_reach(back, max_ratio, "b_", False), keys & (F.col("_step") == F.col("_reach")))
    backward_low = _below_reach(outward, max_ratio, "", True).join(
        back.where("b_smallest_step").withColumn("_step", _fine_step("b_low", max_ratio)),
        keys & (F.col("_step") == F.col("_reach")))
    return forward_low.unionByName(backward_low), meet


def _close(outward: DataFrame, homeward: DataFrame, max_ratio: float) -> DataFrame:
    pairs, meet = formed_pairs(outward, homeward, max_ratio)
    rest = F.slice("b_nodes", F.lit(2), F.size("b_nodes"))
    return pairs.where(meet).select(
        F.concat(F.array("start"), "nodes", rest).alias("nodes"),
        F.concat("legs", "b_legs").alias("legs"),
        F.least("low", "b_low").alias("low"), F.greatest("high", "b_high").alias("high"))


def _from_smallest_id(values: str) -> Column:
    at = F.array_position("nodes", F.array_min("nodes")).cast("int")
    n = F.size("nodes")
    return F.concat(F.slice(values, at, n), F.slice(values, F.lit(1), at - 1))


def _listed(closed: DataFrame) -> DataFrame:
    return closed.select(
        _from_smallest_id("nodes").alias("ciclo"), F.size("nodes").alias("num_saltos"),
        F.col("low").alias("monto_minimo_tramo"),
        F.round(F.col("high").cast("double") / F.col("low").cast("double"), 3)
        .alias("ratio_monto"),
        _from_smallest_id("legs").alias("montos"))


class CycleSearch:
    """Simple directed cycles of `min_nodes`..`max_hops` nodes with similar legs.

    The halves are grown once and then closed in the way a question needs.
    """

    def __init__(self, network: DataFrame, min_amount, max_hops: int,
                 max_ratio: float = Settings.max_leg_ratio,
                 min_nodes: int = Settings.min_cycle_nodes, prune_rounds: int = 2):
        edges = _banded(_edges(network, min_amount), max_ratio)
        for _ in range(prune_rounds):      # a round reads its input three times
            edges = settle(_connected(edges))
        self.edges, self.max_ratio, self.least_leg = edges, max_ratio, None
        self.lengths = range(max(min_nodes, 2), max_hops + 1)
        self._halves = {True: {1: _first_legs(edges, True)}, False: {1: _first_legs(edges, False)}}

    def at_least(self, min_amount) -> CycleSearch:
        """The same search for cycles whose smallest leg is `min_amount` or more."""
        part = object.__new__(CycleSearch)
        part.__dict__ = {**self.__dict__, "least_leg": min_amount}
        return part

    def _half(self, legs: int, forward: bool) -> DataFrame:
        known = self._halves[forward]
        if legs not in known:
            self._half(legs - 1, forward)
            known[legs] = settle(_grow(known[legs - 1], self.edges, self.max_ratio, forward))
        if self.least_leg is None:
            return known[legs]
        return known[legs].where(F.col("low") >= F.lit(self.least_leg))

    def _pairs(self) -> Iterator[tuple[DataFrame, DataFrame]]:
        """For each length, the forward and the backward halves of cycles of that length."""
        for n in self.lengths:
            outward = self._half(-(-n // 2), True)
            if n % 2 and outward.isEmpty():
                break
            yield outward, self._half(n // 2, False)

    def cycles(self) -> DataFrame:
        """G1. All cycles. One starts at its smallest ID; `montos[i]` is the leg from node i to
        the next."""
        closed = self.edges.sparkSession.createDataFrame(
            [], "nodes array<string>, legs array<decimal(38,2)>, low decimal(38,2), "
                "high decimal(38,2)")
        for outward, homeward in self._pairs():
            closed = closed.unionByName(_close(outward, homeward, self.max_ratio))
        return _listed(closed)

    def members(self) -> DataFrame:
        """Distinct IDs that take part in some cycle; no cycle is listed."""
        found = self.edges.select(F.col("source").alias("rfc")).limit(0)
        for outward, homeward in self._pairs():
            outward, back, meet = _meeting(outward, homeward, self.max_ratio)
            for closing, start, nodes in (
                    (outward.join(back, meet, "left_semi"), "start", "nodes"),
                    (back.join(outward, meet, "left_semi"), "b_start", "b_nodes")):
                found = found.unionByName(closing.select(F.explode(
                    F.concat(F.array(start), nodes)).alias("rfc")))
        return found.distinct()

    def smallest(self, rfcs: DataFrame) -> DataFrame:
        """G2. For each ID one cycle that contains it: fewest nodes, then smallest IDs.

        An ID is looked for among longer cycles only while it has no shorter one, and
        only halves that hold such an ID are closed, from either side.
        """
        wanted, chosen = settle(rfcs.select("rfc").distinct()), None
        for outward, homeward in self._pairs():
            out_hit, out_rest = _holding(outward, wanted)
            home_hit, _ = _holding(homeward, wanted)
            closed = _listed(_close(out_hit, homeward, self.max_ratio).unionByName(
                _close(out_rest, home_hit, self.max_ratio)))
            found = settle(_first_cycle(closed, wanted))
            chosen = found if chosen is None else chosen.unionByName(found)
            wanted = settle(wanted.join(found, "rfc", "left_anti"))
            if wanted.isEmpty():
                break
        if chosen is None:
            chosen = _first_cycle(self.cycles(), wanted)
        return chosen


def _holding(halves: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The halves that hold a wanted ID, and the others."""
    keys = ["band", "start", "nodes"]      # a half is a path, so these tell it
    hit = (halves.select(*keys, F.explode(F.concat(F.array("start"), "nodes")).alias("rfc"))
           .join(wanted, "rfc", "left_semi").select(*keys).distinct())
    return halves.join(hit, keys, "left_semi"), halves.join(hit, keys, "left_anti")


def _first_cycle(cycles: DataFrame, rfcs: DataFrame) -> DataFrame:
    member = cycles.select(
        F.explode("ciclo").alias("rfc"), "num_saltos", "ciclo", "montos", "ratio_monto")
    chosen = member.join(rfcs, "rfc", "left_semi").groupBy("rfc").agg(
        F.min(F.struct("num_saltos", "ciclo", "montos", "ratio_monto")).alias("c"))
    return chosen.select("rfc", "c.*")


def money_cycles(network: DataFrame, min_amount, max_hops: int,
                 max_ratio: float = Settings.max_leg_ratio,
                 min_nodes: int = Settings.min_cycle_nodes, prune_rounds: int = 2) -> DataFrame:
    """G1. The list of all cycles."""
    return CycleSearch(network, min_amount, max_hops, max_ratio, min_nodes,
                       prune_rounds).cycles()


def cycle_members(cycles: DataFrame | CycleSearch) -> DataFrame:
    """Distinct IDs that take part in some cycle of a list or of a search."""
    if isinstance(cycles, CycleSearch):
        return cycles.members()
    return cycles.select(F.explode("ciclo").alias("rfc")).distinct()


def cycle_of(rfcs: DataFrame, cycles: DataFrame | CycleSearch) -> DataFrame:
    """G2. For each ID one cycle that contains it, from a list or by a search."""
    if isinstance(cycles, CycleSearch):
        return cycles.smallest(rfcs)
    return _first_cycle(cycles, rfcs.select("rfc").distinct())


def cycle_legs(cycles: DataFrame, *keep: str) -> DataFrame:
    """One row per leg: leg number, origin, destination, amount."""
    n = F.size("ciclo")
    return cycles.select(*keep, "ciclo", "montos", F.posexplode("ciclo").alias("tramo", "origen")
                         ).select(
        *keep, "tramo", "origen",
        F.element_at("ciclo", (F.col("tramo") + 1) % n + 1).alias("destino"),
        F.element_at("montos", F.col("tramo") + 1).alias("monto"))
