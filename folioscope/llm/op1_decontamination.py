"""Benchmark decontamination with a suffix automaton over the words of all items.

The automaton accepts every run of words of any item. The words of a document are
streamed through it; after each word the state tells the longest run ending there that
an item also holds. Where that is a window or longer, the window's words are hit. Items
shorter than a window count as a whole. `clean` cuts the hit spans out of texts and
drops documents that consist mostly of them.

Items are dealt into shards of a bounded number of words (a longer item is cut into
pieces that overlap by a window less one), and one automaton at a time is broadcast, so
its size does not depend on the benchmark. Documents stay where they are: no shuffle.

Null and empty texts have no words and are not contaminated. An item without words has
no window. An item with a null ID hits words but is not listed. Repeated items and
documents need nothing special; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import bucket_count, byte_texts, prepare, table
from folioscope.session import settle

WINDOW = 10
SHARD_WORDS = 100_000
# Word characters are digits, letters and all beyond ASCII; A-Z is lowered. In UTF-8 that
# is a map of bytes to bytes, so offsets do not change.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWERED = bytes(c if _WORD.match(bytes([c])) else 0x20 for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWERED).split()


class Automaton:
    """Generalised suffix automaton of lists of words, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes], bool]], window: int):
        """items: (ID, words, whole); a piece that is not whole has only full windows."""
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words, _ in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark(items)

    def _add(self, length: int, link: int, arrows: dict) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of exactly the runs of p followed by word, taken out of q."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def _mark(self, items: list) -> None:
        """For states: the one that stands for the last window, and whose windows end there."""
        n = len(self.next)
        self.top = [-1] * n
        self.owners: dict[int, set] = {}
        own_short: dict[int, dict[int, set]] = {}
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.top[s] = s if self.length[up] < self.window else self.top[up]
        for item, words, whole in items:
            state = 0
            for word in words:
                state = self.next[state][word]
                # From the root, the words so far are the longest run of this state or
                # a suffix-link child's, so the window's state is found from it.
                if self.top[state] >= 0:
                    self.owners.setdefault(self.top[state], set()).add(item)
            if whole and 0 < len(words) < self.window:
                own_short.setdefault(state, {}).setdefault(len(words), set()).add(item)
        self.short: dict[int, list[tuple[int, set]]] = {}
        for s in order if own_short else ():
            found = [*self.short.get(self.link[s], ()), *own_short.get(s, {}).items()]
            if found:
                self.short[s] = found

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set, int]:
        """Which words are hit (None: none), the items, and the longest run matched."""
        arrows, link, length, top, short = self.next, self.link, self.length, self.top, self.short
        first, window = arrows[0], self.window
        state = run = longest = 0
        hit, items = None, set()
        for i, word in enumerate(words):
            to = arrows[state].get(word)
            if to is None:
                if word not in first:
                    state = run = 0
                    continue
                while to is None:
                    state = link[state]
                    to = arrows[state].get(word)
                run = length[state]
            state, run = to, run + 1
            if run >= window or state in short:
                if run > longest:
                    longest = run
                if hit is None:
                    hit = np.zeros(len(words), bool)
                if run >= window:
                    hit[i + 1 - window:i + 1] = True
                    items |= self.owners[top[state]]
                for size, owners in short.get(state, ()):
                    if size <= run:
                        hit[i + 1 - size:i + 1] = True
                        items |= owners
        return (hit if items else None), items, longest


def pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, words, whole): items cut into overlapping pieces of bounded size."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sizes, whole = [], [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), byte_texts(batch)):
                words = words_of(text)
                for a in range(0, max(len(words) - window + 1, 1) if words else 0, most):
                    part = words[a:a + most + window - 1]
                    ids.append(item)
                    texts.append(b" ".join(part))
                    sizes.append(len(part))
                    whole.append(len(part) == len(words))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(texts, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(whole, pa.bool_())],
                names=["item_id", "words", "size", "whole"])
    return benchmark.selectExpr("cast(item_id as string) item_id", "text").mapInArrow(
        work, "item_id string, words binary, size long, whole boolean")


def automata(benchmark: DataFrame, window: int = WINDOW,
             shard_words: int = SHARD_WORDS) -> Iterator[bytes]:
    """One stored automaton after the other, each over a bounded number of words."""
    cut = settle(pieces(benchmark, window, shard_words // 4))
    shards = bucket_count(cut.agg(F.sum("size")).first()[0] or 0, shard_words)
    shard = F.pmod(F.xxhash64("item_id", "words"), F.lit(shards))
    for k in range(shards):
        rows = cut.filter(shard == k).orderBy("item_id", "words").collect()
        yield pickle.dumps(Automaton([(r[0], bytes(r[1]).split(b" "), r[3]) for r in rows],
                                     window), protocol=5)


def closed_hits(automaton: Automaton, words: list[bytes]) -> tuple:
    """The hits, and those that arise when hit words are cut and the rest moves together."""
    hit, items, longest = automaton.hits(words)
    more = hit
    while more is not None:
        kept = np.flatnonzero(~hit)
        more, _, _ = automaton.hits([words[i] for i in kept])
        if more is not None:
            hit[kept[more]] = True
    return hit, items, longest


def _through(docs: DataFrame, stored: bytes, closed: bool) -> DataFrame:
    """Add what one automaton finds to __hits (packed bits), __items and __longest."""
    broadcast = docs.sparkSession.sparkContext.broadcast(stored)
    fields = [c for c in docs.columns if c not in ("__hits", "__items", "__longest")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(broadcast.value)
        for batch in batches:
            hits, items, longest = [], [], []
            for text, bits, known, most in zip(
                    byte_texts(batch), batch.column("__hits").to_pylist(),
                    batch.column("__items").to_pylist(), batch.column("__longest").to_pylist()):
                words = words_of(text)
                hit, found, run = closed_hits(automaton, words) if closed else \
                    automaton.hits(words)
                if hit is not None:
                    new = np.packbits(hit)
                    bits = (new | np.frombuffer(bits, np.uint8) if bits else new).tobytes()
                hits.append(bits)
                items.append(sorted({*known, *(x for x in found if x is not None)}))
                longest.append(max(run, most))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in fields), pa.array(hits, pa.binary()),
                 pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())],
                names=[*fields, "__hits", "__items", "__longest"])
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*fields).dtypes)
    return docs.mapInArrow(work, schema + ", __hits binary, __items array<string>, __longest long")


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
            shard_words: int = SHARD_WORDS, closed: bool = False) -> DataFrame:
    """The rows of docs with __hits, __items and __longest."""
    prepare(docs.sparkSession)
    found = docs.withColumns({"__hits": F.lit(None).cast("binary"),
                              "__items": F.array().cast("array<string>"),
                              "__longest": F.lit(0).cast("long")})
    for k, stored in enumerate(automata(benchmark, window, shard_words)):
        found = _through(settle(found) if k else found, stored, closed)
    return found


def summary(found: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [len(words_of(t)) for t in byte_texts(batch)]
            bits = batch.column("__hits").to_pylist()
            n_hit = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) if b else 0
                     for b in bits]
            items = batch.column("__items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()),
                 pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                          pa.string()),
                 pa.array([h > 0 for h in n_hit]), batch.column("__longest")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
                       "longest_match"])
    return found.mapInArrow(work, "doc_id long, n_words long, n_hit long, n_items long, "
                                  "items_sha256 string, contaminated boolean, longest_match long")


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without the runs of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans = [m.span() for m in _WORD.finditer(text.translate(_LOWERED))]
    kept, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        kept.append(text[at:spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*kept, text[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.8,
          window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents without hit spans; those hit over more than max_coverage are dropped.

    Other columns are kept as they are, but for n_chars, which follows the text. Words that
    a cut brings together are looked at again, by one shard of items at a time.
    """
    columns = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), []
            for i, bits in enumerate(batch.column("__hits").to_pylist()):
                if bits is None:
                    keep.append(i)
                    continue
                raw = texts[i].encode()
                n = len(words_of(raw))
                hit = np.unpackbits(np.frombuffer(bits, np.uint8))[:n]
                if hit.sum() <= max_coverage * n:
                    texts[i] = cut_spans(raw, hit).decode()
                    keep.append(i)
            new = batch.set_column(batch.schema.get_field_index("text"), "text",
                                   pa.array(texts, pa.string())).select(columns)
            if "n_chars" in columns:
                sizes = [n if b is None else len(t) for n, b, t in zip(
                    batch.column("n_chars").to_pylist(), batch.column("__hits").to_pylist(), texts)]
                new = new.set_column(columns.index("n_chars"), "n_chars",
                                     pa.array(sizes, new.column("n_chars").type))
            yield new.take(pa.array(keep, pa.int64()))
    return matched(docs, benchmark, window, shard_words, closed=True).mapInArrow(
        work, docs.schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    return summary(matched(docs, table(spark, sf_dir, "benchmark")))
