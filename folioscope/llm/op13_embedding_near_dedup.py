"""Embedding near-dedup: a subspace pigeonhole join within labels.

Unit vectors of cosine c lie sqrt(2 - 2c) apart. They are rotated (a fixed orthogonal matrix
spreads what they differ in over all coordinates) and split into blocks of BLOCK
coordinates. If two are near, then in one block at least their squared distance is within
the block's share of the budget, in proportion to its coordinates; so a range join of every
block finds every pair.

The range join has two steps. First the blocks alone meet, eight numbers a row: the
vectors that have a partner in a block are marked, and most have none. Then only marked
ones meet again, with all their coordinates, and each pair is verified exactly, by the
cosine of the vectors as given. A pair is counted in the first block that finds it, so
nothing has to be made distinct. A task gives the number of links of each vector and a
forest of them; pairs are never written.

Rows meet in cells of the first coordinates of a block; a vector visits every cell that its
range touches, and is counted at home. The number of gridded coordinates follows from the
largest label. Where a cell has many members all the same (a cloud of near copies), it is cut into chunks
and each pair of chunks is a group of its own, so memory is bounded and the square of the
cloud, which its links are, is spread over tasks. Inside a group, tiles of a k-d order are
skipped by the distance of their boxes. Equal vectors of a label are one vector with a
number of copies.

Vectors that are null or empty, zero, or that hold a null or non-finite component, link with nothing, like
those of a null label. Vectors of different length never link. Rows equal in all columns are
vectors of their own and link each other. A null ID is never a component's ID unless all its
rows have none; it is kept if its component has no ID. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.op4_near_dedup import _merge
from folioscope.llm.shared import bucket_count, prepare, table
from folioscope.session import settle

LEAST_COSINE = 0.98
BLOCK = 8                # coordinates of a block
CELL = 4                 # width of a cell, in ranges of its block
CELL_ROWS = 16_384       # of a label: above it, another coordinate is gridded
CHUNK = 4096             # rows of a cell that meet as one group
TILE = 256
BUCKET_ROWS = 20_000
_SLACK = 1e-6            # what single precision and cell edges may be off by
_UNSURE = 1e-9           # cosines this close to the threshold are computed pair by pair


@cache
def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


@cache
def blocks(dims: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks begin and end, and the budget of each."""
    edges = np.linspace(0, dims, -(-dims // BLOCK) + 1).round().astype(int)
    return edges, (2 - 2 * least) * np.diff(edges) / dims * (1 + 1e-9)


def scaled(values: list) -> np.ndarray:
    """A vector in double precision, by a power of two near one."""
    vector = np.array(values, np.float64)
    return np.ldexp(vector, -int(np.frexp(np.abs(vector).max())[1]))


def comparable() -> Column:
    """Whether a row can link with others."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return (F.col("label").isNotNull() & finite
            & F.exists("embedding", lambda x: x != 0))


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, label, dims, copies, least_id, h1, h2, vector, turned) of distinct vectors."""
    distinct = rows.filter("h1 is not null").groupBy("h1", "h2").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scaled(v) for v in batch.column("embedding").to_pylist()]
            turned = [rotation(len(v)) @ (v / np.sqrt(v @ v)) for v in found]
            part = batch.drop_columns(["embedding"])
            yield (part.append_column("dims", pa.array([len(v) for v in found], pa.int32()))
                   .append_column("vector", pa.array([v.tobytes() for v in found], pa.binary()))
                   .append_column("turned", pa.array([v.tobytes() for v in turned], pa.binary())))

    made = distinct.mapInArrow(work, "h1 long, h2 long, label long, copies long, least_id long, "
                                     "dims int, vector binary, turned binary")
    return settle(made.withColumn("node", F.monotonically_increasing_id()))


# --- cells and chunks ---------------------------------------------------------------

def cells(points: np.ndarray, reach: float, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cell of every point and those that its reach touches."""
    row, cell = np.arange(len(points)), np.zeros(len(points), np.uint64)
    home = np.ones(len(points), bool)
    width = CELL * reach
    for k in range(min(depth, points.shape[1])):
        x = points[row, k].astype(np.float64)
        low = np.floor((x - reach) / width).astype(np.int64)
        high = np.floor((x + reach) / width).astype(np.int64)
        own = np.floor(x / width).astype(np.int64)
        times = high - low + 1                 # one or two, as a cell is wider than the reach
        at = np.repeat(np.arange(len(row)), times)
        place = low[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        row, home = row[at], home[at] & (place == own[at])
        cell = cell[at] * np.uint64(0x9E3779B97F4A7C15) + place.view(np.uint64) + np.uint64(k + 1)
    return row, cell.view(np.int64), home


def placed(points: DataFrame, least: float, depth: int, marked: bool) -> DataFrame:
    """The rows of every block and cell; of marked blocks only, and then with the vectors."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column("dims").to_pylist(), np.int64)
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                turned = np.frombuffer(b"".join(part.column("turned").to_pylist()),
                                       np.float64).reshape(len(part), dims)
                edges, budget = blocks(dims, least)
                for block in range(len(budget)):
                    mine = part
                    points = turned[:, edges[block]:edges[block + 1]]
                    if marked:
                        own = np.array(part.column("block").to_pylist(), np.int64) == block
                        mine, points = part.filter(pa.array(own)), points[own]
                    reach = float(np.sqrt(budget[block])) * (1 + _SLACK) + _SLACK
                    row, cell, home = cells(points, reach, depth)
                    taken = mine.take(pa.array(row))
                    raw = [p.tobytes() for p in points.astype(np.float32)]
                    columns = [taken.column("node"), taken.column("label"), taken.column("dims"),
                               pa.array(np.full(len(row), block, np.int32)), pa.array(cell),
                               pa.array(home)]
                    if marked:
                        columns += [taken.column(c) for c in ("copies", "vector", "turned")]
                    else:
                        columns.append(pa.array([raw[i] for i in row.tolist()], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "node long, label long, dims int, block int, cell long, home boolean, " + (
        "copies long, vector binary, turned binary" if marked else "point binary")
    names = [c.split()[0] for c in schema.split(", ")]
    return points.mapInArrow(work, schema)


KEY = ["label", "dims", "block", "cell"]


def dealt(rows: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """Rows with the pair of chunks they meet in, and a number of buckets for them."""
    counts = settle(rows.groupBy(*KEY).agg(F.count("*").alias("members"),
                                           F.count_if("home").alias("homes"))
                    .filter((F.col("members") > 1) & (F.col("homes") > 0))
                    .select(*KEY, "members",
                            F.ceil(F.col("members") / chunk).cast("int").alias("chunks")))
    total = counts.agg(F.sum(F.col("members") * F.col("chunks"))).first()[0] or 0
    n = F.col("chunks")
    met = (rows.join(counts.drop("members"), KEY)
           .withColumn("own", F.pmod(F.xxhash64("node"), n).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
           .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"),
                         "side": (F.col("own") > F.col("other")).cast("int")})
           .drop("own", "other", "chunks"))
    return met, bucket_count(total, BUCKET_ROWS)


def bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEY, "low", "high"), F.lit(buckets))


def groups(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    keys = rows[[*KEY, "low", "high"]].to_numpy(np.int64)
    order = np.lexsort(keys.T)
    keys = keys[order]
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    for a, b in zip([0, *edges], [*edges, len(keys)]):
        if b - a > 1:
            yield rows.iloc[order[a:b]]


# --- tiles --------------------------------------------------------------------------

def k_d_order(points: np.ndarray, tile: int) -> np.ndarray:
    """An order in which every `tile` rows lie close together: halves of the widest side."""
    out, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= tile:
            out.append(rows)
            continue
        part = points[rows]
        side = int(np.argmax(part.max(0) - part.min(0)))
        half = tile * -(-len(rows) // (2 * tile))
        cut = np.argpartition(part[:, side], half - 1) if half < len(rows) else np.arange(len(rows))
        open_ += [rows[cut[half:]], rows[cut[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def close_tiles(points: np.ndarray, budget: float) -> Iterator[tuple[slice, slice]]:
    """Pairs of tiles (the first not after the second) whose boxes are within the budget."""
    slices = [slice(i, min(i + TILE, len(points))) for i in range(0, len(points), TILE)]
    low = np.array([points[s].min(0) for s in slices])
    high = np.array([points[s].max(0) for s in slices])
    for i, p in enumerate(slices):
        gap = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i]))
        for j in np.flatnonzero((gap * gap).sum(1) <= budget).tolist():
            yield p, slices[i + j]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, coordinate by coordinate, so that both orders give the same."""
    out = np.zeros((len(a), len(b)), a.dtype)
    for x, y in zip(a.T, b.T):
        d = x[:, None] - y[None, :]
        d *= d
        out += d
    return out


def with_partner(least: float):
    """(node, block): the rows at home whose block is near another one's."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, found_in = [], []
        for group in groups(rows):
            dims, block = int(group["dims"].iloc[0]), int(group["block"].iloc[0])
            budget = (np.sqrt(blocks(dims, least)[1][block]) * (1 + _SLACK) + _SLACK) ** 2
            points = np.frombuffer(b"".join(group["point"]), np.float32).reshape(len(group), -1)
            order = k_d_order(points, TILE)
            points, group = points[order], group.iloc[order]
            home, side = group["home"].to_numpy(bool), group["side"].to_numpy()
            two_sides = group["low"].iloc[0] != group["high"].iloc[0]
            hit = np.zeros(len(group), bool)
            for p, q in close_tiles(points, budget):
                near = squared(points[p], points[q]) <= budget
                if two_sides:
                    near &= side[p, None] != side[None, q]
                elif p == q:
                    np.fill_diagonal(near, False)
                hit[p] |= near.any(1)
                hit[q] |= near.any(0)
            nodes.append(group["node"].to_numpy(np.int64)[hit & home])
            found_in.append(np.full(len(nodes[-1]), block, np.int32))
        return pd.DataFrame({"node": np.concatenate(nodes or [np.zeros(0, np.int64)]),
                             "block": np.concatenate(found_in or [np.zeros(0, np.int32)])})
    return work


def cosines_reach(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each pair of rows of a and b is `least` or more."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))) >= least


def verified(least: float):
    """(node, other, links): what links a row at home in this block first, and a forest."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        out_node, out_other, out_links = [], [], []
        for group in groups(rows):
            dims, block = int(group["dims"].iloc[0]), int(group["block"].iloc[0])
            edges, budget = blocks(dims, least)
            turned = np.frombuffer(b"".join(group["turned"]), np.float64).reshape(-1, dims)
            order = k_d_order(turned[:, edges[block]:edges[block + 1]], TILE)
            turned, group = turned[order], group.iloc[order]
            vector = np.frombuffer(b"".join(group["vector"]), np.float64).reshape(-1, dims)
            parts = [np.ascontiguousarray(turned[:, edges[k]:edges[k + 1]]) for k in range(block + 1)]
            home, side = group["home"].to_numpy(bool), group["side"].to_numpy()
            copies = group["copies"].to_numpy(np.int64)
            two_sides = group["low"].iloc[0] != group["high"].iloc[0]
            links, parent = np.zeros(len(group), np.int64), np.arange(len(group))
            for p, q in close_tiles(parts[block], budget[block]):
                first = squared(parts[block][p], parts[block][q]) <= budget[block]
                if two_sides:
                    first &= side[p, None] != side[None, q]
                elif p == q:
                    np.fill_diagonal(first, False)
                for k in range(block):
                    if not first.any():
                        break
                    first &= squared(parts[k][p], parts[k][q]) > budget[k]
                if not first.any():
                    continue
                cosine = turned[p] @ turned[q].T
                unsure = first & (np.abs(cosine - least) <= _UNSURE)
                linked = first & (cosine >= least)
                a, b = np.nonzero(unsure)
                linked[a, b] = cosines_reach(vector[p][a], vector[q][b], least)
                links[p] += linked @ copies[q]
                if p != q:
                    links[q] += copies[p] @ linked
                a, b = np.nonzero(linked)
                _merge(parent, a + p.start, b + q.start)
            node = group["node"].to_numpy(np.int64)
            some = np.flatnonzero((links > 0) & home | (parent != np.arange(len(group))))
            out_node.append(node[some])
            out_other.append(node[parent[some]])
            out_links.append(np.where(home, links, 0)[some])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"node": np.concatenate(out_node or none),
                             "other": np.concatenate(out_other or none),
                             "links": np.concatenate(out_links or none)})
    return work


def near_vectors(embeddings: DataFrame, least: float = LEAST_COSINE,
                 cell_rows: int = CELL_ROWS, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    prepare(embeddings.sparkSession)
    key = ["label", F.size("embedding"), "embedding"]   # a hash passes over nulls
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding")).withColumns({
            "h1": F.when(comparable(), F.xxhash64(*key)),
            "h2": F.when(comparable(), F.xxhash64(F.lit("second"), *key))})
    nodes = nodes_of(rows)
    largest = nodes.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, int(np.ceil(np.log2(max(largest, 1) / cell_rows))))
    met, buckets = dealt(settle(placed(nodes.select("node", "label", "dims", "turned"), least,
                                       depth, False)), chunk)
    marks = settle(met.groupBy(bucket(buckets)).applyInPandas(
        with_partner(least), "node long, block int").distinct())
    whole = marks.join(nodes.select("node", "label", "dims", "copies", "vector", "turned"), "node")
    met, buckets = dealt(settle(placed(whole, least, depth, True)), chunk)
    found = settle(met.groupBy(bucket(buckets)).applyInPandas(
        verified(least), "node long, other long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = settle(nodes.select("node", "h1", "h2", "copies", "least_id").join(links, "node", "left")
                   .join(roots, "node", "left")
                   .withColumn("component", F.coalesce("component", "node")))
    named = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_hash = known.join(named, "component").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("__links"),
        "component_id")
    own = F.when(F.col("__links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "h1", "h2").join(by_hash, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("__links", F.lit(0)).alias("n_links"), own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with recursive valid as (
  select row_number() over () as k, vec_id, label, cast(embedding as double[]) as v
  from embeddings where label is not null and embedding is not null),
links as (
  select a.k, b.k as o from valid a join valid b on a.label = b.label and a.k <> b.k
  and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (
  select k, k as o from links union select r.k, l.o from reach r join links l on l.k = r.o),
named as (select r.k, min(v.vec_id) as component_id from reach r join valid v on v.k = r.o
          group by r.k),
counted as (select k, count(*) as n from links group by k),
found as (select v.vec_id, v.k, c.n, coalesce(n.component_id, v.vec_id) as component_id
          from valid v left join counted c on c.k = v.k left join named n on n.k = v.k)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept from found
union all
select vec_id, 0, vec_id, true from embeddings where label is null or embedding is null"""
