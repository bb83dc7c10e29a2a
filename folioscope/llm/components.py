"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b) but the smallest of each component.

    Each round hangs larger neighbours under the smallest one seen and then every node
    under its smallest parent, until nothing changes; the number of rounds grows with the
    logarithm of the longest chain. A round is written to the shared folder. A node with
    many links is only ever the key of a minimum, which is summed up before the shuffle,
    and of a join whose hot keys are split.
    """
    tree = settle(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up"))
                  .filter("node <> up").distinct())
    state = _state(tree)
    while state[0]:
        both = tree.unionByName(tree.select(F.col("up").alias("node"), F.col("node").alias("up")))
        least = both.groupBy("node").agg(F.min("up").alias("_up")).select(
            "node", F.least("node", "_up").alias("least"))
        large = (both.join(least, "node").filter("up > node")
                 .select(F.col("up").alias("node"), F.col("least").alias("up")).distinct())
        least = large.groupBy("node").agg(F.min("up").alias("least"))
        small = (large.join(least, "node").filter("up <> least")
                 .select(F.col("up").alias("node"), F.col("least").alias("up"))
                 .unionByName(least.withColumnRenamed("least", "up")).distinct())
        tree = settle(small)
        last, state = state, _state(tree)
        if state == last:
            break
    return tree.select("node", F.col("up").alias("component"))


def _state(tree: DataFrame) -> tuple:
    row = tree.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "up")),
                   F.sum(F.xxhash64("node", "up") % 1_000_003)).first()
    return row[0], row[1], row[2]
