"""Which strings occur more than once, asked chunk by chunk and answered with bits.

A task cuts its documents into chunks of some megabytes and reduces a chunk's strings
(blocks of words, windows, anchors) to sorted distinct hashes in one request per bucket of
hash values. A bucket sees every hash once per chunk, so a string that a third of all
documents hold costs a few bytes per chunk. The answer to a request is one bit per hash;
the chunk's own table of places turns it back into places in documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import byte_texts, chunks
from folioscope.session import settle

CHUNK_BYTES = 4 << 20
HOT = 4096            # a string that occurs more often is reported as hot

REQUEST = ("chunk string, bucket int, hashes binary, counts binary, places binary, "
           "doc_ids array<string>, text_keys array<long>, sizes array<long>")


@dataclass
class Strings:
    """Strings of a chunk: hash (n x 1 or n x 2 of uint64), place, and places per document."""

    hashes: np.ndarray
    places: np.ndarray
    sizes: np.ndarray


def packed(hashes: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of every hash, eight from the first column."""
    raw = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    return np.ascontiguousarray(raw[:, :width]).tobytes()


def unpacked(raw: bytes, width: int) -> np.ndarray:
    """The same as columns of uint64."""
    columns = -(-width // 8)
    wide = np.zeros((len(raw) // width, 8 * columns), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view(np.uint64)


def by_bucket(hashes: np.ndarray, buckets: int, width: int) -> Iterator[tuple]:
    """(bucket, order, starts): the rows of a bucket sorted by hash, and where each hash starts.

    The bucket is taken from the high bits, which `width` may cut off, so it adds to them.
    """
    if width < 8:
        kept = hashes & np.uint64((1 << 8 * width) - 1)
    else:
        kept = hashes
    bucket = ((hashes[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((*kept.T[::-1], bucket))
    bucket, kept = bucket[order], kept[order]
    new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    new = new_bucket | np.concatenate([[True], (kept[1:] != kept[:-1]).any(1)])
    edges = [*np.flatnonzero(new_bucket), len(order)]
    firsts = np.flatnonzero(new)
    at = np.searchsorted(firsts, edges)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        yield int(bucket[a]), order[a:b], firsts[at[i]:at[i + 1]] - a


def docs_in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list, pa.RecordBatch]]:
    """(chunk key, texts, rows) for runs of documents of about CHUNK_BYTES."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = byte_texts(batch)
        for a, b in chunks([len(t) for t in texts], CHUNK_BYTES):
            yield f"{task}:{number}", texts[a:b], batch.slice(a, b - a)
            number += 1


def requests(docs: DataFrame, strings: Callable[..., Strings], buckets: int,
             width: int) -> DataFrame:
    """One row per chunk and bucket, and one per chunk (bucket -1) that lists its documents.

    `strings` gets the texts of a chunk and its rows.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts, rows in docs_in_chunks(batches):
            found = strings(texts, rows)
            if not len(found.hashes):
                continue
            out = {"bucket": [-1], "hashes": [None], "counts": [None], "places": [None]}
            for bucket, order, starts in by_bucket(found.hashes, buckets, width):
                counts = np.diff([*starts, len(order)])
                out["bucket"].append(bucket)
                out["hashes"].append(packed(found.hashes[order[starts]], width))
                out["counts"].append(np.minimum(counts, 255).astype(np.uint8).tobytes())
                out["places"].append(_with_overflow(counts, found.places[order]))
            rest = len(out["bucket"]) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * (rest + 1)), pa.array(out["bucket"], pa.int32()),
                 pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary()),
                 pa.array(out["places"], pa.binary()),
                 pa.array([rows.column("doc_id").cast(pa.string()).to_pylist()] + [None] * rest,
                          pa.list_(pa.string())),
                 *(pa.array([x] + [None] * rest, pa.list_(pa.int64())) for x in (
                     rows.column("text_key").to_pylist(), found.sizes.tolist()))],
                names=[c.split()[0] for c in REQUEST.split(", ")])
    return docs.mapInArrow(work, REQUEST)


def _with_overflow(counts: np.ndarray, places: np.ndarray) -> bytes:
    """The places, after the true counts of those that do not fit a byte."""
    large = counts[counts >= 255]
    return np.concatenate([[len(large)], large, places]).astype(np.uint32).tobytes()


def _without_overflow(counts: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, places = np.frombuffer(counts, np.uint8).astype(np.int64), np.frombuffer(raw, np.uint32)
    large = int(places[0])
    n[n == 255] = places[1:1 + large]
    return n, places[1 + large:].astype(np.int64)


def probes(docs: DataFrame, hashes: Callable[[list], np.ndarray], buckets: int,
           width: int) -> DataFrame:
    """Hashes that are looked for but not asked about: (bucket, hashes) without a chunk."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _ in docs_in_chunks(batches):
            found = hashes(texts)
            if not len(found):
                continue
            rows = [(b, packed(found[order[starts]], width))
                    for b, order, starts in by_bucket(found, buckets, width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()),
                 pa.array([h for _, h in rows], pa.binary())], names=["bucket", "hashes"])
    return docs.mapInArrow(work, "bucket int, hashes binary").select(
        F.lit(None).cast("string").alias("chunk"), "bucket", "hashes",
        F.lit(None).cast("binary").alias("counts"))


def answers(asked: DataFrame, probed: DataFrame | None, width: int, hot: int = HOT) -> DataFrame:
    """(chunk, bucket, bits, hot_bits): which hashes occur more than once, and very often."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["chunk"].notna().to_numpy()
        parts = [unpacked(h, width) for h in rows["hashes"]]
        own = [p for p, m in zip(parts, mine) if m]
        if not own:
            return pd.DataFrame({"chunk": [], "bucket": [], "bits": [], "hot_bits": []})
        asked_of = np.concatenate(own)
        counts = np.frombuffer(b"".join(rows["counts"][mine]), np.uint8).astype(np.int64)
        order = np.lexsort(asked_of.T[::-1])
        ranked = asked_of[order]
        new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)])
        total = np.add.reduceat(counts[order], np.flatnonzero(new))
        distinct = ranked[new][:, 0]
        for p, m in zip(parts, mine):
            if not m:                     # of one column, and distinct
                at = np.minimum(np.searchsorted(distinct, p[:, 0]), len(distinct) - 1)
                total[at[distinct[at] == p[:, 0]]] += 1
        totals = np.empty(len(order), np.int64)
        totals[order] = total[np.cumsum(new) - 1]
        cuts = np.cumsum([len(p) for p in own])[:-1]
        found = [(c, b, np.packbits(t > 1).tobytes(), np.packbits(t > hot).tobytes())
                 for c, b, t in zip(rows["chunk"][mine], rows["bucket"][mine],
                                    np.split(totals, cuts)) if (t > 1).any()]
        return pd.DataFrame(found, columns=["chunk", "bucket", "bits", "hot_bits"])

    rows = asked.filter("bucket >= 0").select("chunk", "bucket", "hashes", "counts")
    if probed is not None:
        rows = rows.unionByName(probed)
    return rows.groupBy("bucket").applyInPandas(
        work, "chunk string, bucket int, bits binary, hot_bits binary")


def placed(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """(doc_id, text_key, places, hot): the places in each document of repeated strings.

    Both are arrays of unsigned 32-bit numbers; hot places are listed apart.
    """
    def work(asked: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or answered.empty:
            return pd.DataFrame({"doc_id": [], "text_key": [], "places": [], "hot": []})
        listed = asked[asked["bucket"] < 0].iloc[0]
        by_bucket = asked.set_index("bucket")
        found = {"places": [], "hot": []}
        for answer in answered.itertuples():
            row = by_bucket.loc[answer.bucket]
            counts, places = _without_overflow(row["counts"], row["places"])
            bits = np.unpackbits(np.frombuffer(answer.bits, np.uint8))[:len(counts)]
            hot = np.unpackbits(np.frombuffer(answer.hot_bits, np.uint8))[:len(counts)]
            found["places"].append(places[np.repeat((bits & ~hot & 1).astype(bool), counts)])
            found["hot"].append(places[np.repeat(hot.astype(bool), counts)])
        ends = np.cumsum(listed["sizes"])
        starts = ends - listed["sizes"]
        ids = [None if i is None else int(i) for i in listed["doc_ids"]]
        out = {"doc_id": pd.array(ids, "Int64"), "text_key": listed["text_keys"]}
        for name, parts in found.items():
            places = np.sort(np.concatenate(parts))
            cuts = np.searchsorted(places, [starts, ends])
            out[name] = [(places[a:b] - s).astype(np.uint32).tobytes()
                         for a, b, s in zip(*cuts, starts)]
        out = pd.DataFrame(out)
        return out[(out["places"].str.len() > 0) | (out["hot"].str.len() > 0)]

    return (asked.drop("hashes").groupBy("chunk").cogroup(answered.groupBy("chunk"))
            .applyInPandas(work, "doc_id long, text_key long, places binary, hot binary"))


def repeated(docs: DataFrame, strings: Callable[..., Strings], buckets: int, width: int,
             others: Callable[[list], np.ndarray] | None = None, hot: int = 1 << 62) -> DataFrame:
    """Places of strings that occur again, among themselves or among `others` of all texts.

    Rows equal in ID and text have the same places, so one row stands for them.
    """
    asked = settle(requests(docs, strings, buckets, width))
    probed = probes(docs, others, buckets, width) if others else None
    answered = settle(answers(asked, probed, width, hot))
    return settle(placed(asked, answered).groupBy("doc_id", "text_key").agg(
        F.max("places").alias("places"), F.max("hot").alias("hot")))
