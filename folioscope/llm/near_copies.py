"""Near copies by their words: five-word shingles, a Jaccard similarity of 0.8 or more.

First come the SimHash fingerprints of op4, over five-word shingles: texts of one fingerprint
and the links that its tiles give within 4 bits are candidates. A pair of similarity 0.8 is
usually further apart than that, so more candidates come from min-hashes: BANDS bands of ROWS hashes each, and texts that agree in a
whole band meet. A pair of similarity 0.8 misses all bands once in 4,600 times, one of 0.85
once in 100,000. A candidate is a link only if the exact similarity of the shingle sets says
so. First all texts of a band value are held against one of them. Then, where they are not
all in one component, those of different components are held against each other, in two steps. Tile
against tile, a byte of each min-hash tells which texts have a partner left to look at; pairs
that agree in fewer than AGREE bytes are none (for a similarity of 0.8 that is one pair in
tens of thousands). Only those texts meet again, with their shingles, and pairs are counted out
exactly where they meet, in the first band they share, as long as they are in different
components. What a group gives is a forest of its links: no pairs are ever written, and a
cloud of texts that are nearly similar enough costs time, but no rows.

A band value of many texts is cut into chunks, and each pair of chunks is a group of its own.
A text with fewer than five words is one shingle; texts without words are copies of each
other. Letter case and white space do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.hashing import mixed, run_hashes
from folioscope.llm.op4_near_dedup import fingerprint, links, one_of_each
from folioscope.llm.shared import bucket_count, byte_texts, keyed, prepare
from folioscope.session import settle

SHINGLE = 5
BANDS, ROWS = 16, 4
AGREE = 37
CHUNK, TILE = 1024, 512          # texts of a band value that meet as one group; of a tile
BUCKET_ROWS, BUCKET_SHINGLES = 40_000, 2_000_000
_RANDOM = np.random.default_rng(77).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_SLICE = 4096          # shingles hashed at a time


def shingles(text: bytes) -> tuple[int, np.ndarray]:
    """The hash of a text's words and the set of hashes of its shingles."""
    words = text.lower().split()
    key = xxhash.xxh64_intdigest(b" ".join(words), 7)
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    return key, np.unique(run_hashes(hashes, min(SHINGLE, len(words)), 0)) if words else hashes


def min_hashes(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _SLICE):
        part = found[None, i:i + _SLICE] * (_RANDOM[0] | np.uint64(1)) + _RANDOM[1]
        least = np.minimum(least, part.min(1))
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, n, bands, sketch, print) of every row; node stands for the words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, values, sketches, prints = [], [], [], [], []
            for text in byte_texts(batch):
                key, found = shingles(text)
                least = mixed(min_hashes(found))
                nodes.append(key)
                sizes.append(len(found))
                values.append(run_hashes(least, ROWS, 1)[::ROWS].view(np.int64))
                sketches.append(least.astype(np.uint8).tobytes())
                prints.append(fingerprint(text, SHINGLE))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"),
                 pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(values, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
                 pa.array(np.array(prints, np.uint64).view(np.int64))],
                names=["doc_id", "text_key", "node", "n", "bands", "sketch", "print"])
    return keyed(docs).mapInArrow(work, "doc_id long, text_key long, node long, n long, "
                                        "bands array<long>, sketch binary, print long")


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the given nodes; nodes also has one row's doc_id and text_key."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t)[1].view(np.int64) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(found, pa.list_(pa.int64()))],
                names=["node", "shingles"])
    at = nodes.select("node", F.col("id").alias("__id"), F.col("key").alias("__key"))
    texts = keyed(docs).join(at, F.col("doc_id").eqNullSafe(F.col("__id"))
                             & (F.col("text_key") == F.col("__key"))).select("node", "text")
    return (texts.mapInArrow(work, "node long, shingles array<long>")
            .dropDuplicates(["node"]))


def similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of 0.8 or more."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _sized(a: str, b: str):
    """Sets whose sizes differ more than this cannot be that similar."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


KEY = ["band", "value"]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (node, band, value, component) with the pair of chunks of the value they meet in."""
    chunks = rows.groupBy(*KEY).agg(
        F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.min("component").alias("x"),
        F.max("component").alias("y")).filter("x <> y").drop("x", "y")
    n = F.col("chunks")
    return (rows.join(chunks, KEY)
            .withColumn("own", F.pmod(F.xxhash64("node"), n).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
            .select("node", "component", *KEY, F.least("own", "other").alias("low"),
                    F.greatest("own", "other").alias("high"),
                    (F.col("own") > F.col("other")).cast("int").alias("side")))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64(*KEY, "low", "high"), F.lit(buckets))


class Group:
    """The texts of one band value, or of two of its chunks."""

    def __init__(self, rows: pd.DataFrame):
        self.node, self.component, self.side, self.n = (
            rows[c].to_numpy(np.int64) for c in ("node", "component", "side", "n"))
        self.band, self.value = int(rows["band"].iloc[0]), int(rows["value"].iloc[0])
        self.two_sides = rows["low"].iloc[0] != rows["high"].iloc[0]
        self.sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1)
        self.bands = np.stack(rows["bands"].to_numpy())

    def candidates(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Tile pairs and which of their pairs are to be looked at here."""
        for i in range(0, len(self.node), TILE):
            for j in range(i, len(self.node), TILE):
                p, q = (slice(k, min(k + TILE, len(self.node))) for k in (i, j))
                close = self.component[p, None] != self.component[None, q]
                close &= 5 * np.minimum(self.n[p, None], self.n[None, q]) >= 4 * np.maximum(
                    self.n[p, None], self.n[None, q])
                if self.two_sides:
                    close &= self.side[p, None] != self.side[None, q]
                if not close.any():
                    continue
                same = np.zeros(close.shape, np.uint8)
                for x, y in zip(self.sketch[p].T, self.sketch[q].T):
                    same += x[:, None] == y[None, :]
                close &= same >= AGREE
                for band in range(self.band):          # an earlier one has looked at these
                    if not close.any():
                        break
                    close &= self.bands[p, band, None] != self.bands[None, q, band]
                if close.any():
                    yield p, q, close


def _groups(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    keys = rows[[*KEY, "low", "high"]].to_numpy(np.int64)
    order = np.lexsort(keys.T)
    keys = keys[order]
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    for a, b in zip([0, *edges], [*edges, len(keys)]):
        if b - a > 1:
            yield rows.iloc[order[a:b]]


def with_candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, band, value): the texts that have a partner to look at in a band value."""
    out = [np.zeros((0, 3), np.int64)]
    for part in _groups(rows):
        group = Group(part)
        some = np.zeros(len(group.node), bool)
        for p, q, close in group.candidates():
            some[p] |= close.any(1)
            some[q] |= close.any(0)
        node = group.node[some]
        out.append(np.stack([node, np.full(len(node), group.band),
                             np.full(len(node), group.value)], 1))
    return pd.DataFrame(np.concatenate(out), columns=["node", *KEY])


def counted_out(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b): a forest of the links that exact similarity gives in every group."""
    out = [np.zeros((0, 2), np.int64)]
    for part in _groups(rows):
        group = Group(part)
        sizes = part["shingles"].map(len).to_numpy(np.int64)
        _, numbers = np.unique(np.concatenate(part["shingles"].to_numpy()), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        held = np.zeros(numbers.max() + 1, bool)
        _, root = np.unique(group.component, return_inverse=True)   # joined as links come
        for p, q, close in group.candidates():
            for i in np.flatnonzero(close.any(1)).tolist():
                x = p.start + i
                others = np.flatnonzero(close[i]) + q.start
                others = others[root[others] != root[x]]
                if not len(others):
                    continue
                own = numbers[starts[x]:ends[x]]
                held[own] = True
                lengths = sizes[others]
                at = np.cumsum(lengths) - lengths
                places = np.arange(lengths.sum()) + np.repeat(starts[others] - at, lengths)
                shared = np.add.reduceat(held[numbers[places]], at, dtype=np.int64)
                held[own] = False
                for y in others[9 * shared >= 4 * (lengths + sizes[x])].tolist():
                    if root[y] != root[x]:
                        root[root == root[y]] = root[x]
                        out.append(group.node[None, [x, y]])
    return pd.DataFrame(np.concatenate(out), columns=["a", "b"])


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): the nodes that SimHash links, as a forest; those of one fingerprint hang on one."""
    worded = nodes.filter("n > 0")
    firsts = settle(worded.groupBy(F.col("print").alias("fingerprint"))
                    .agg(F.min(F.struct("node", "n")).alias("first"))
                    .select("fingerprint", F.col("first.node").alias("first"),
                            F.col("first.n").alias("first_n")))
    same = worded.withColumnRenamed("print", "fingerprint").join(firsts, "fingerprint").select(
        F.col("first").alias("a"), F.col("node").alias("b"), F.col("first_n").alias("a_n"),
        F.col("n").alias("b_n")).filter("a <> b")
    ends = [firsts.select(F.col("fingerprint").alias(f"{e}_print"), F.col("first").alias(e),
                          F.col("first_n").alias(f"{e}_n")) for e in "ab"]
    near = (links(firsts).toDF("a_print", "b_print").join(ends[0], "a_print")
            .join(ends[1], "b_print").select("a", "b", "a_n", "b_n"))
    return same.unionByName(near).filter(_sized("a_n", "b_n")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that keep all components of the candidates' links."""
    hashed = settle(print_pairs(nodes))
    met = settle(nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
                 .filter("n > 0"))
    values = (met.groupBy(*KEY)
              .agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("first"))
              .filter("members > 1"))
    values = settle(values.select(*KEY, "members", F.col("first.node").alias("first"),
                                  F.col("first.n").alias("first_n")))
    met = settle(met.join(values, KEY))
    asked = met.select("node").union(hashed.select(F.explode(F.array("a", "b")))).distinct()
    sets = settle(shingle_sets(docs, nodes.join(asked, "node", "left_semi")))
    # A value's texts often meet again in other bands; one look at the same pair is enough.
    stars = (met.filter(F.col("node") != F.col("first")).filter(_sized("n", "first_n"))
             .select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")))
    stars = settle(similar(sets, hashed.unionByName(stars).distinct()))
    named = components(stars).withColumnRenamed("component", "__in")
    rest = settle(met.filter("members > 2").join(named, "node", "left")
                  .select("node", *KEY, F.coalesce("__in", "node").alias("component")))
    open_ = dealt(rest).join(nodes.select("node", "n", "bands", "sketch"), "node")
    marks = settle(open_.groupBy(_bucket(bucket_count(rest.count(), BUCKET_ROWS)))
                   .applyInPandas(with_candidates, "node long, band int, value long").distinct())
    left = settle(dealt(rest.join(marks, ["node", *KEY], "left_semi"))
                  .join(nodes.select("node", "n", "bands", "sketch"), "node"))
    shingles_left = left.agg(F.sum("n")).first()[0] or 0
    found = (left.join(sets, "node")
             .groupBy(_bucket(bucket_count(shingles_left, BUCKET_SHINGLES)))
             .applyInPandas(counted_out, "a long, b long"))
    return stars.unionByName(settle(found))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, root) of every row of docs."""
    prepare(docs.sparkSession)
    rows = settle(signatures(docs))
    nodes = settle(rows.groupBy("node").agg(F.min(F.struct(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "n", "bands", "sketch",
        "print"))
        .alias("r")).select("node", "r.*"))
    roots = components(near_links(docs, nodes)).select("node", "component")
    return rows.select("doc_id", "text_key", "node").join(roots, "node", "left").select(
        "doc_id", "text_key", F.coalesce("component", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest ID of each group of near copies, with all its columns."""
    return one_of_each(docs, near_copies(docs))
