"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised where they lie. One longer than a sequence is cut so that all
pieces but the first are full; full pieces are sequences of their own. The rests are
dealt in turn into groups of bounded size, however many rows are equal, and each group is
packed by best-fit decreasing: a segment tree over remaining capacities finds the tightest open sequence
in a number of steps that depends on the capacity alone. A group wastes about one
sequence of thousands.

The ids are those of the public byte-level vocabulary, its added tokens such as
<|endoftext|> included, as the tokenizers library gives them; tiktoken's encoder reads the
same vocabulary as ranks and gives the same ids several times faster (a test holds them
against each other). Its search fails on about a million blanks
before a word, so a text with a long run of blanks goes through the tokenizers library. A
null text is empty and is one token, the end mark. Repeated rows and null IDs are packed like others.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import bucket_count, keyed, prepare, str_texts, table
from folioscope.session import settle

END = 2
BLANKS = 100_000      # a run from which a text is left to the tokenizers library
_LONG_RUN = re.compile(rf"(?<!\s)\s{{{BLANKS}}}")
_ENCODERS: dict = {}
_LIBRARY: dict = {}


def encoder(vocabulary: str | None = None):
    """The encoder of a ranks file and the added tokens in the JSON file beside it, made once
    per process."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        with open(Path(path).with_suffix(".json"), encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        _ENCODERS[vocabulary] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[vocabulary]


def library(vocabulary: str | None = None):
    """The tokenizers library's reading of the JSON file beside a ranks file."""
    if vocabulary not in _LIBRARY:
        import public_tokenizers
        from tokenizers import Tokenizer
        path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
        _LIBRARY[vocabulary] = Tokenizer.from_file(str(Path(path).with_suffix(".json")))
    return _LIBRARY[vocabulary]


def token_ids(vocabulary: str | None = None) -> Callable[[str], list[int]]:
    """What gives the ids of a text."""
    mine = encoder(vocabulary)

    def encode(text: str) -> list[int]:
        if len(text) >= BLANKS and _LONG_RUN.search(text):
            return library(vocabulary).encode(text, add_special_tokens=False).ids
        return mine.encode(text, allowed_special="all")
    return encode


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n tokens; only the first may be short."""
    full, rest = divmod(n, capacity)
    return ([rest] if rest else []) + [capacity] * full


class OpenBins:
    """Open sequences by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list] = defaultdict(list)

    def put(self, remaining: int, item) -> None:
        self.bins[remaining].append(item)
        self._change(remaining, 1)

    def _change(self, remaining: int, by: int) -> None:
        node = remaining + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take_tightest(self, need: int):
        """The open bin with the least remaining capacity of `need` or more, or None."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while True:                  # up to the first ancestor with bins to the right
                if node == 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:    # and down to its leftmost leaf
                node = 2 * node if count[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        self._change(remaining, -1)
        return remaining, self.bins[remaining].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the place in it of every item, and the number of bins."""
    bins, opened = OpenBins(capacity), 0
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        found = bins.take_tightest(need)
        if found is None:
            remaining, number, opened = capacity, opened, opened + 1
        else:
            remaining, number = found
        bin_of[i], offset[i] = number, capacity - remaining
        if remaining > need:
            bins.put(remaining - need, number)
    return bin_of, offset, opened


def tokenised(docs: DataFrame, capacity: int, groups: int, vocabulary: str | None) -> DataFrame:
    """doc_id, group, number of tokens and the checksums of the pieces of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(vocabulary)
        for batch in batches:
            sizes, sums, known = [], [], {}
            for text in str_texts(batch):
                if text not in known:
                    ids = np.array([*encode(text), END], "<u4")
                    at = np.cumsum([0, *cuts(len(ids), capacity)])
                    known[text] = len(ids), np.array(
                        [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])],
                        "<u4").tobytes()
                size, checks = known[text]
                sizes.append(size)
                sums.append(checks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("pack_group"), pa.array(sizes, pa.int64()),
                 pa.array(sums, pa.binary())], names=["doc_id", "pack_group", "n", "sums"])
    # The counter of a partition deals its rows in turn. What it dealt is written, so a task that
    # runs again cannot deal otherwise. IDs are strings: pandas has no exact number beside null.
    dealt = keyed(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.pmod(
        F.monotonically_increasing_id(), F.lit(groups)).alias("pack_group"))
    return settle(dealt.mapInArrow(work, "doc_id string, pack_group long, n long, sums binary"))


def pack(docs: DataFrame, capacity: int = 1024, group_rows: int = 16384,
         vocabulary: str | None = None) -> DataFrame:
    """Where every piece of every document lies."""
    prepare(docs.sparkSession)
    groups = bucket_count(docs.count(), group_rows)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        n = rows["n"].to_numpy(np.int64)
        rest, full = n % capacity, n // capacity
        short = np.flatnonzero(rest)
        bin_of, offset, opened = best_fit_decreasing(rest[short], capacity)
        first_bin, first_offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        first_bin[short], first_offset[short] = bin_of, offset
        own = opened + np.cumsum(full) - full            # sequences of the full pieces
        pieces = full + (rest > 0)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        is_rest = (piece == 0) & (rest[row] > 0)
        number = piece - (rest[row] > 0)                 # of the full piece in its document
        base = int(rows["pack_group"].iloc[0]) << 32
        return pd.DataFrame({
            "doc_id": rows["doc_id"].to_numpy(object)[row], "piece": piece.astype(np.int32),
            "start": np.where(is_rest, 0, rest[row] + number * capacity),
            "length": np.where(is_rest, rest[row], capacity),
            "ids_crc32": np.frombuffer(b"".join(rows["sums"]), "<u4").astype(np.int64),
            "sequence_id": base + np.where(is_rest, first_bin[row], own[row] + number),
            "offset": np.where(is_rest, first_offset[row], 0)})

    packed = tokenised(docs, capacity, groups, vocabulary).groupBy("pack_group").applyInPandas(
        work, "doc_id string, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
