"""Suffix-array dedup on bytes.

Every window of `window` bytes has an anchor: the 32 bytes in it with the smallest hash.
Equal windows have equal anchors, so windows are compared only where their anchors are
equal. Neighbouring windows with the same anchor lie in one segment, some 600 bytes; a
segment whose anchor is nowhere else is never sent. The segments of equal anchors meet in
a bucket. Equal segments are repeats as they are; different ones go into a suffix array:
the suffixes smaller than their successors are sorted directly, the rest are put in place
by scanning the buckets of first bytes from left to right, and then common prefixes of
neighbours are computed. Neighbours that agree in a whole window are repeats.

An anchor in more than `HOT` segments, such as one in a passage that very many documents
share, would make its bucket large. The windows of such segments are compared one by one
by 10 bytes of hash beside the bucket, as in the word operator.

Null and empty texts and those shorter than a window lose nothing. Repeated rows are
documents of their own, so they lose all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.hashing import codes, mixed, run_hashes
from folioscope.llm.op3_substrings import covered, with_places
from folioscope.llm.repeats import HOT, Strings, docs_in_chunks, repeated
from folioscope.llm.shared import bucket_count, byte_texts, keyed, prepare, table, text_bytes
from folioscope.session import settle

WINDOW = 400
GRAM = 32
BUCKET_BYTES = 8 << 20        # of text per bucket
_PLACE_BITS = np.uint64(24)   # chunks are shorter than 2^24 bytes, or one text by itself


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring keys, by running minima of blocks."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    blocks = full.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n - width + 1], right[width - 1:n])


def segments(text: bytes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, first and last window of every segment of a text."""
    if len(text) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    anchors, firsts, lasts = [], [], []
    step = (1 << int(_PLACE_BITS)) - window    # very long texts go in overlapping parts
    for a in range(0, len(text) - window + 1, step):
        data = np.frombuffer(text, np.uint8)[a:a + step + window - 1]
        hashes = run_hashes(codes(0)[data], gram, 0)
        keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        least = window_least(keys, window - gram + 1)
        edges = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1], [True]]))
        anchors.append(mixed(least[edges[:-1]] >> _PLACE_BITS))
        firsts.append(edges[:-1] + a)
        lasts.append(edges[1:] - 1 + a)
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(lasts)


# --- the suffix array ------------------------------------------------------------

def _first_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one number that sorts like them."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = np.zeros(len(data), np.uint64)
    for k in range(8):
        keys |= wide[k:k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return keys


def _sorted_directly(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their first `depth` bytes, eight at a time; only ties go on."""
    order = places[np.argsort(keys[places], kind="stable")]
    first = keys[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    last = len(keys) - 1
    active = np.arange(len(order))
    for offset in range(8, depth, 8):
        # Of the still tied places: the group of each, and its next eight bytes.
        tied = ~new[active]
        tied[:-1] |= tied[1:]
        active = active[tied]
        if not len(active):
            break
        starts = new[active]
        group = np.cumsum(starts)
        value = keys[np.minimum(order[active] + offset, last)]
        differ = np.concatenate([[False], (value[1:] != value[:-1]) & ~starts[1:]])
        mixed_groups = np.zeros(group[-1] + 1, bool)
        mixed_groups[group[differ]] = True
        rows = np.flatnonzero(mixed_groups[group])
        if len(rows):
            ranks = np.lexsort((value[rows], group[rows]))
            order[active[rows]] = order[active[rows][ranks]]
            value[rows] = value[rows][ranks]
            new[active[1:]] |= value[1:] != value[:-1]
    return order


def suffix_array(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """All places, sorted by their first `depth` bytes at least.

    data has a mark (any byte) at `ends`, which counts as smaller than all bytes.
    """
    n = len(data)
    char = data.astype(np.uint16) + 1
    char[ends] = 0
    clean = data.copy()
    clean[ends] = 0
    # A suffix is smaller than its successor if the next different byte is larger.
    step = np.flatnonzero(char[1:] != char[:-1])
    at = np.searchsorted(step, np.arange(n))
    smaller = np.zeros(n, bool)
    has = at < len(step)
    smaller[has] = char[step[at[has]]] < char[step[at[has]] + 1]
    direct = np.flatnonzero(smaller & (char > 0))
    direct = _sorted_directly(direct, _first_bytes(clean), depth)
    bounds = np.searchsorted(char[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []

    def scan(entries: np.ndarray, c: int) -> np.ndarray:
        """Put the larger predecessors into their buckets; those of bucket c are returned."""
        before = entries[entries > 0] - 1
        first = char[before]
        own = before[(first == c) & ~smaller[before]] if c else before[:0]
        above = before[first > c]
        if len(above):
            first = char[above]
            order = np.argsort(first, kind="stable")
            above, first = above[order], first[order]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for part, f in zip(np.split(above, cuts[1:]), first[cuts]):
                induced[f].append(part)
        return own

    for c in range(257):
        entries = np.concatenate([ends if c == 0 else direct[:0], *induced[c]])
        while len(entries):
            out.append(entries)
            entries = scan(entries, c)
        entries = direct[bounds[c]:bounds[c + 1]]
        if len(entries):
            out.append(entries)
            scan(entries, c)
    return np.concatenate(out)


def common_prefix_reaches(data: np.ndarray, a: np.ndarray, b: np.ndarray,
                          length: int) -> np.ndarray:
    """Whether the common prefix of each pair of places has `length` bytes or more."""
    keys = _first_bytes(data)
    going = np.arange(len(a))
    offsets = [*range(0, length - 8, 8), length - 8] if length >= 8 else []
    for offset in offsets:
        going = going[keys[a[going] + offset] == keys[b[going] + offset]]
    for offset in range(length) if length < 8 else ():
        going = going[data[a[going] + offset] == data[b[going] + offset]]
    reaches = np.zeros(len(a), bool)
    reaches[going] = True
    return reaches


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string, which of its windows is found at another place in them."""
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    is_window = np.ones(len(data), bool)
    for back in range(0, window):
        is_window[np.maximum(ends - back, ends - sizes)] = False
    is_window[ends] = False
    order = suffix_array(data, ends, window)
    order = order[is_window[order]]
    same = common_prefix_reaches(data, order[:-1], order[1:], window)
    found = np.zeros(len(data), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return [found[e - s:e - window + 1] for e, s in zip(ends, sizes)]


# --- segments that share an anchor ------------------------------------------------

SEGMENT_ROWS = ("chunk string, bucket int, anchors binary, counts binary, lengths binary, "
                "data binary, places binary, doc_ids array<string>, text_keys array<long>, "
                "ends array<long>")


def _sent(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """The segments whose numbers are in `places`, equal ones of a chunk once, by bucket."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts, rows in docs_in_chunks(batches):
            by_bucket: dict[int, dict] = {}
            start = 0
            for text, found in zip(texts, rows.column("places").to_pylist()):
                picked = np.frombuffer(found or b"", np.uint32)
                if len(picked):
                    anchors, firsts, lasts = segments(text, window, gram)
                    for h, a, b in zip(anchors[picked].tolist(), firsts[picked].tolist(),
                                       lasts[picked].tolist()):
                        known = by_bucket.setdefault(h * buckets >> 64, {})
                        known.setdefault((h, text[a:b + window]), []).append(start + a)
                start += len(text)
            if not by_bucket:
                continue
            n = len(by_bucket)
            column = lambda make: pa.array(
                [None] + [make(known) for known in by_bucket.values()], pa.binary())
            once = lambda x, kind: pa.array([x] + [None] * n, pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * (n + 1)), pa.array([-1, *by_bucket], pa.int32()),
                 column(lambda k: np.array([h for h, _ in k], np.uint64).tobytes()),
                 column(lambda k: np.array([len(p) for p in k.values()], np.uint32).tobytes()),
                 column(lambda k: np.array([len(s) for _, s in k], np.uint32).tobytes()),
                 column(lambda k: b"".join(s for _, s in k)),
                 column(lambda k: np.concatenate(list(k.values())).astype(np.uint32).tobytes()),
                 once(rows.column("doc_id").cast(pa.string()).to_pylist(), pa.string()),
                 once(rows.column("text_key").to_pylist(), pa.int64()),
                 once(np.cumsum([len(t) for t in texts]).tolist(), pa.int64())],
                names=[c.split()[0] for c in SEGMENT_ROWS.split(", ")])
    return docs.mapInArrow(work, SEGMENT_ROWS)


def _compared(sent: DataFrame, window: int) -> DataFrame:
    """(chunk, bucket, bits): a bit for each window of each string that was sent."""
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        total: dict[tuple, int] = {}
        listed = []
        for row in rows.itertuples():
            ends = np.cumsum(np.frombuffer(row.lengths, np.uint32).astype(np.int64))
            keys = [(h, row.data[a:b]) for h, a, b in zip(
                np.frombuffer(row.anchors, np.uint64).tolist(), [0, *ends[:-1]], ends)]
            for k, c in zip(keys, np.frombuffer(row.counts, np.uint32).tolist()):
                total[k] = total.get(k, 0) + c
            listed.append((row.chunk, row.bucket, keys))
        by_anchor: dict[int, list] = {}
        for key in total:
            by_anchor.setdefault(key[0], []).append(key)
        several = [k for keys in by_anchor.values() if len(keys) > 1 for k in keys]
        bits = {}
        if several:
            bits = dict(zip(several, repeated_windows([k[1] for k in several], window)))
        for key, count in total.items():
            if count > 1:
                bits[key] = np.ones(len(key[1]) - window + 1, bool)
        out = []
        for chunk, bucket, keys in listed:
            found = [bits[k] if k in bits else np.zeros(len(k[1]) - window + 1, bool)
                     for k in keys]
            if any(f.any() for f in found):
                out.append((chunk, bucket, np.packbits(np.concatenate(found)).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "bucket", "bits"])

    return (sent.filter("bucket >= 0")
            .select("chunk", "bucket", "anchors", "counts", "lengths", "data")
            .groupBy("bucket").applyInPandas(work, "chunk string, bucket int, bits binary"))


def _placed(sent: DataFrame, compared: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, places): the bytes at which a repeated window starts."""
    def work(sent: pd.DataFrame, compared: pd.DataFrame) -> pd.DataFrame:
        if sent.empty or compared.empty:
            return pd.DataFrame({"doc_id": [], "text_key": [], "places": []})
        listed = sent[sent["bucket"] < 0].iloc[0]
        rows = sent.set_index("bucket")
        parts = []
        for answer in compared.itertuples():
            row = rows.loc[answer.bucket]
            counts = np.frombuffer(row["counts"], np.uint32)
            n = np.frombuffer(row["lengths"], np.uint32).astype(np.int64) - window + 1
            bits = np.unpackbits(np.frombuffer(answer.bits, np.uint8))[:n.sum()].astype(bool)
            places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
            hit = [np.flatnonzero(b) for b in np.split(bits, np.cumsum(n)[:-1])]
            parts += [p + hit[i] for p, i in zip(places, np.repeat(np.arange(len(n)), counts))]
        found = np.sort(np.concatenate(parts))
        ends = np.asarray(listed["ends"], np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        cuts = np.searchsorted(found, [starts, ends])
        ids = [None if i is None else int(i) for i in listed["doc_ids"]]
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text_key": listed["text_keys"],
                            "places": [spans_of(found[a:b] - s)
                                       for a, b, s in zip(*cuts, starts)]})
        return out[out["places"].str.len() > 0]

    return (sent.select("chunk", "bucket", "counts", "lengths", "places", "doc_ids", "text_keys",
                        "ends").groupBy("chunk").cogroup(compared.groupBy("chunk"))
            .applyInPandas(work, "doc_id long, text_key long, places binary"))


def spans_of(places: np.ndarray) -> bytes:
    """Sorted places as (first, last) pairs of runs."""
    if not len(places):
        return b""
    breaks = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.concatenate([[0], breaks + 1])],
                     places[np.concatenate([breaks, [len(places) - 1]])]], 1).astype(
                         np.uint32).tobytes()


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
            bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, spans, places): where repeated windows start, as runs and one by one."""
    buckets = bucket_count(text_bytes(docs), bucket_bytes)

    def anchors(texts: list[bytes], _) -> Strings:
        found = [segments(t, window, gram)[0] for t in texts]
        hashes = np.concatenate(found)
        return Strings(hashes[:, None], np.arange(len(hashes)),
                       np.array([len(f) for f in found]))

    def hot_windows(texts: list[bytes], rows: pa.RecordBatch) -> Strings:
        at, start = [], 0
        for text, found in zip(texts, rows.column("hot").to_pylist()):
            _, firsts, lasts = segments(text, window, gram)
            picked = np.frombuffer(found, np.uint32)
            at += [np.arange(a, b + 1) + start for a, b in zip(firsts[picked], lasts[picked])]
            start += len(text)
        at = np.concatenate(at)
        data = np.frombuffer(b"".join(texts), np.uint8)
        return Strings(np.stack([run_hashes(codes(w)[data], window, w)[at] for w in (0, 1)], 1), at,
                       np.array([len(t) for t in texts]))

    docs = keyed(docs)
    anchored = repeated(docs, anchors, buckets, 8, hot=hot)
    some = with_places(docs, anchored).filter(F.col("places").isNotNull())
    sent = settle(_sent(some, buckets, window, gram))
    cold = _placed(sent, settle(_compared(sent, window)), window).groupBy(
        "doc_id", "text_key").agg(F.max("places").alias("spans"))
    many = with_places(docs, anchored.filter(F.octet_length("hot") > 0)).filter(
        F.col("hot").isNotNull())
    many = repeated(many, hot_windows, buckets, 10).select(
        "doc_id", "text_key", F.col("places").alias("places"))
    cold = cold.withColumn("places", F.lit(None).cast("binary"))
    many = many.withColumn("spans", F.lit(None).cast("binary"))
    return settle(cold.unionByName(many).groupBy("doc_id", "text_key").agg(
        F.max("spans").alias("spans"), F.max("places").alias("places")))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
           bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""
    prepare(docs.sparkSession)
    found = repeats(docs, window, gram, bucket_bytes, hot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, places in zip(byte_texts(batch), batch.column("spans").to_pylist(),
                                           batch.column("places").to_pylist()):
                gone = covered(places, len(text), window)
                for a, b in np.frombuffer(spans or b"", np.uint32).reshape(-1, 2).tolist():
                    gone[a:b + window] = True
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
                edge = gone[1:] & ~gone[:-1]
                out.append((len(text), len(text) - len(kept),
                            int(edge.sum()) + bool(len(gone) and gone[0]),
                            hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_places(keyed(docs), found).mapInArrow(
        work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "kept binary")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).drop("kept")
