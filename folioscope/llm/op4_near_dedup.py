"""SimHash near-dedup: 64-bit fingerprints, compared exactly in tiles.

Fingerprints within the radius agree in one of `radius + 1` bands of bits, so only
fingerprints that share a band meet: that deals the work to tasks and loses no link.
Where they meet they are sorted by population count and compared tile against tile with
exclusive-or and bit counts; tile pairs whose counts differ by more than the radius are
skipped. Only distinct fingerprints are compared, so copies cost nothing. A band value
that many of them share is cut into chunks, and each pair of chunks is a group of its
own. A group gives a forest of its links, not all of them, which keeps every component.

A text without words, empty or null, has fingerprint zero and is linked like any other.
A null doc_id is never a component's ID unless all its documents have none. Repeated rows
share a fingerprint. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import components
from folioscope.llm.shared import bucket_count, byte_texts, keyed, prepare, table
from folioscope.session import settle

RADIUS, SHINGLE = 4, 4
CHUNK = 8192          # most rows of a band value that are compared as one group
TILE = 1024
BUCKET_ROWS = 40_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority of each bit over the hashes of all shingles of a text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    ends, digest = ends.tolist(), xxhash.xxh64_digest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1:] or ends[-1:])]
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(-1, 64)
    full = len(bits) // 255 * 255        # sums of 255 bits fit a byte
    ones = bits[:full].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    ones += bits[full:].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint as a signed long) of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in byte_texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"),
                 pa.array(prints.view(np.int64))], names=["doc_id", "text_key", "fingerprint"])
    return keyed(docs).mapInArrow(work, "doc_id long, text_key long, fingerprint long")


def bands(column: Column, radius: int) -> Column:
    """The 64 bits in radius + 1 bands, as (band, value)."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*(
        F.struct(F.lit(i).alias("band"),
                 F.shiftrightunsigned(column, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))))


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite linked rows; parent holds the root of every row before and after."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def tile_links(prints: np.ndarray, side: np.ndarray, radius: int,
               tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among the prints; if side has both 0 and 1, between the sides."""
    weight = np.bitwise_count(prints)
    order = np.argsort(weight, kind="stable")
    prints, side, weight = prints[order], side[order], weight[order].astype(np.int16)
    parent = np.arange(len(prints))
    two_sides = side.any() and not side.all()
    starts = range(0, len(prints), tile)
    for i in starts:
        for j in range(i, len(prints), tile):
            if weight[j] - weight[min(i + tile, len(prints)) - 1] > radius:
                break                  # later tiles differ even more
            close = np.bitwise_count(prints[i:i + tile, None] ^ prints[None, j:j + tile]) <= radius
            if two_sides:
                close &= side[i:i + tile, None] != side[None, j:j + tile]
            a, b = np.nonzero(close)
            a, b = a + i, b + j
            _merge(parent, a[a < b], b[a < b])
    linked = np.flatnonzero(parent != np.arange(len(prints)))
    return prints[linked], prints[parent[linked]]


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints, as forests that keep all components."""
    met = prints.select("fingerprint", F.explode(bands(F.col("fingerprint"), radius)).alias("at")
                        ).select("fingerprint", "at.*")
    hot = (met.groupBy("band", "value").count().filter(F.col("count") > chunk)
           .select("band", "value", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    n = F.coalesce("chunks", F.lit(1))
    dealt = (met.join(hot, ["band", "value"], "left")
             .withColumn("own", F.pmod(F.xxhash64("fingerprint"), n).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
             .select("fingerprint", "band", "value", F.least("own", "other").alias("low"),
                     F.greatest("own", "other").alias("high"),
                     (F.col("own") > F.col("other")).cast("int").alias("side")))
    buckets = bucket_count((radius + 1) * prints.count(), BUCKET_ROWS)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[["band", "value", "low", "high"]].to_numpy(np.int64)
        order = np.lexsort(keys.T)
        keys = keys[order]
        prints = rows["fingerprint"].to_numpy(np.int64).view(np.uint64)[order]
        side = rows["side"].to_numpy(np.int8)[order]
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        found = [tile_links(prints[a:b], side[a:b], radius)
                 for a, b in zip([0, *edges], [*edges, len(keys)]) if b - a > 1]
        a = np.concatenate([f[0] for f in found] or [prints[:0]])
        b = np.concatenate([f[1] for f in found] or [prints[:0]])
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (dealt.groupBy(F.pmod(F.xxhash64("band", "value", "low", "high"), F.lit(buckets)))
            .applyInPandas(work, "a long, b long"))


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fingerprint, root, component_id) of every row of docs."""
    prepare(docs.sparkSession)
    prints = settle(fingerprints(docs))
    distinct = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id")))
    rooted = (distinct.join(components(links(distinct, radius))
                            .select(F.col("node").alias("fingerprint"), "component"),
                            "fingerprint", "left")
              .select("fingerprint", "least_id",
                      F.coalesce("component", "fingerprint").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = rooted.select("fingerprint", "root").join(named, "root")
    return prints.join(groups, "fingerprint")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest ID of each group, with all its columns."""
    return one_of_each(docs, near_groups(docs, radius))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The same for given groups: (doc_id, text_key, root) of every row."""
    columns = docs.columns
    chosen = groups.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("kept"))
    chosen = settle(chosen.select(F.col("kept.doc_id").alias("__id"),
                                  F.col("kept.text_key").alias("__key")).distinct())
    marked = docs.withColumns({"__row_id": F.col("doc_id").cast("long"), "__row_key": F.xxhash64(
        F.coalesce("text", F.lit("")))})
    kept = marked.join(chosen.hint("shuffle_hash"), F.col("__row_id").eqNullSafe(F.col("__id"))
                       & (F.col("__row_key") == F.col("__key")), "left_semi")
    return kept.dropDuplicates(["__row_id", "__row_key"]).select(*columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
                         .alias("fingerprint"), "component_id")
