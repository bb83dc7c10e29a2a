"""Substring dedup on words, with anchors at fixed blocks.

Every document is cut into reference blocks that do not overlap, of half a window. A
window contains a whole block of its own document, so if the window is repeated, that
block is found again at some place, in step with the blocks there or not. So the blocks
are indexed and probed with the rolling windows of block length of all documents, at every
word. Blocks that are found again are extended: all windows around them are compared as
wholes, and runs of repeated windows are the maximal exact repeats. The words that they
cover are removed.

Words are bytes between white space, and a run of words is hashed from their hashes.
Probes carry 5 bytes beside the bucket, where a false match only costs an extension;
windows are compared by 10 bytes beside the bucket, about 2^-86 a pair.

Null and empty texts and those shorter than a window lose nothing. Repeated rows are
documents of their own, so they lose all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.hashing import codes, mixed, powers, run_hashes
from folioscope.llm.repeats import Strings, repeated
from folioscope.llm.shared import bucket_count, byte_texts, keyed, prepare, table, text_bytes

WINDOW = 35
BUCKET_BYTES = 16 << 20       # of text per bucket
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\v\f\r")] = True


@dataclass
class Words:
    """The words of some texts: bytes joined by single spaces, where each word lies, and whose
    it is. `doc` and `place` give a word's document and its number there."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sizes: np.ndarray
    doc: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Words:
        data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        blank = _BLANK[data]
        first = ~blank
        first[1:] &= blank[:-1]                     # the first byte of each word
        after = np.cumsum([len(t) + 1 for t in texts])
        begun = np.cumsum(first)
        sizes = np.diff(np.concatenate([[0], begun[after - 1]])) if len(texts) else after
        keep = ~blank
        keep[1:] |= ~blank[:-1]                     # one blank stays behind each word
        data = np.where(blank, np.uint8(32), data)[keep]
        space = np.flatnonzero(data == 32)
        starts = np.concatenate([[0], space[:-1] + 1]) if len(space) else space
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(space)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Words(data, starts, space, sizes, doc, place)

    def runs(self, length: int) -> np.ndarray:
        """The words at which a run of `length` words of one document starts."""
        return np.flatnonzero(self.place + length <= self.sizes[self.doc])

    def hashes(self, at: np.ndarray, length: int, which: int) -> np.ndarray:
        """Hashes of the runs of `length` words that start at the given words."""
        if not len(at):
            return np.zeros(0, np.uint64)
        long = self.ends - self.starts
        in_word = np.arange(len(self.data)) - np.repeat(self.starts, long + 1)
        spread = codes(which)[self.data] * powers(int(long.max()), which)[in_word]
        return run_hashes(mixed(np.add.reduceat(spread, self.starts)), length, which)[at]


def repeats(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text_key, places): the words at which a repeated window starts, per document."""
    block = (window + 1) // 2           # a window holds a whole block, wherever it starts
    buckets = bucket_count(text_bytes(docs), bucket_bytes)

    def blocks(texts: list[bytes], _) -> Strings:
        words = Words.of(texts)
        at = words.runs(block)
        at = at[(words.place[at] % block == 0) & (words.sizes[words.doc[at]] >= window)]
        sizes = np.bincount(words.doc[at], minlength=len(texts))
        return Strings(words.hashes(at, block, 0)[:, None], np.arange(len(at)), sizes)

    def rolling(texts: list[bytes]) -> np.ndarray:
        words = Words.of(texts)
        at = words.runs(block)
        at = at[(words.place[at] % block != 0) & (words.sizes[words.doc[at]] >= window)]
        return words.hashes(at, block, 0)[:, None]

    def windows(texts: list[bytes], rows: pa.RecordBatch) -> Strings:
        words = Words.of(texts)
        base = np.cumsum(words.sizes) - words.sizes
        near = np.zeros(len(words.doc) + 1, np.int64)
        for i, found in enumerate(rows.column("places").to_pylist()):
            blocks_at = np.frombuffer(found, np.uint32).astype(np.int64) * block
            np.add.at(near, base[i] + np.maximum(blocks_at + block - window, 0), 1)
            np.add.at(near, base[i] + blocks_at + 1, -1)
        at = words.runs(window)
        at = at[np.cumsum(near)[at] > 0]
        return Strings(np.stack([words.hashes(at, window, 0), words.hashes(at, window, 1)], 1),
                       at, words.sizes)

    docs = keyed(docs)
    anchored = repeated(docs, blocks, buckets, 5, rolling).select("doc_id", "text_key", "places")
    around = with_places(docs, anchored).filter(F.col("places").isNotNull())
    return repeated(around, windows, buckets, 10).select("doc_id", "text_key", "places")


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with the columns that `places` has for the same ID and text."""
    places = places.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    return docs.join(places.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(places["_id"])
                     & (docs["text_key"] == places["_key"]), "left").drop("_id", "_key")


def covered(places: bytes | None, n: int, window: int) -> np.ndarray:
    """Which of n words or bytes lie in a window that starts at one of the places."""
    edges = np.zeros(n + 1, np.int32)
    if places:
        at = np.frombuffer(places, np.uint32).astype(np.int64)
        edges[at] += 1
        edges[at + window] -= 1
    return np.cumsum(edges[:-1]) > 0


def remove(docs: DataFrame, window: int = WINDOW,
           bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and the kept text."""
    prepare(docs.sparkSession)
    found = repeats(docs, window, bucket_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, texts = [], [], []
            for text, places in zip(byte_texts(batch), batch.column("places").to_pylist()):
                words = text.split()
                gone = covered(places, len(words), window)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                texts.append(b" ".join(words if not removed[-1] else
                                       [w for w, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(removed, pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                 pa.array([t.decode() for t in texts], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return with_places(keyed(docs), found).mapInArrow(
        work, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).drop("kept_text")
