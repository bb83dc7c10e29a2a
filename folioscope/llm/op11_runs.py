"""Periodic runs of words, found by catching squares online over power-of-two blocks.

Words are appended to a catcher, one or many at a time. Whenever an aligned block of L = 1, 2,
4, ... words is complete it becomes something to catch: every window of L words that ends
with an appended word is compared, by hash, with the two blocks that lie 2L - 1 to 4L - 2
words before it. Any stretch of q >= 2L - 1 words holds an aligned block, so no square of such a period
q escapes its level, and each word costs two comparisons a level. A block that came back
`repeat - 1` times at one distance is compared word by word to both sides; squares of one
period that overlap so merge into one run. Runs that reach the last word are open and
advance with the next words.

A block inside a known run whose period divides the distance shows nothing new (the run of
the distance would be the same stretch), so each run is reported with its smallest period
and a text of one repeated word costs no more than another.

All documents of a batch pass through one catcher, with a mark of its own after each,
which equals no word. Null and empty texts have no words and no runs; repeated rows, null
IDs and other columns change nothing (other columns are not read). `planted` leaves the words
of a document without an ID as they are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.hashing import mixed
from folioscope.llm.shared import byte_texts, chunks, keyed, prepare, table

LEAST, REPEAT = 6, 4        # a run has this many words, and this many times its period
STREAM_WORDS = 1 << 20      # words of one catcher, or one document by itself
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Buffer:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(64, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            more = np.zeros(max(need, 2 * len(self.data)), self.data.dtype)
            more[:self.size] = self.data[:self.size]
            self.data = more
        self.data[self.size:need] = values
        self.size = need

    @property
    def view(self) -> np.ndarray:
        return self.data[:self.size]


class SquareCatcher:
    """Runs of a stream of numbers: length at least `least` and `repeat` times the period."""

    def __init__(self, least: int = LEAST, repeat: int = REPEAT, longest: int | None = None):
        self.least, self.repeat, self.longest = least, max(repeat, 2), longest
        self.words = _Buffer(np.int64)
        self.hashes: list[_Buffer] = []                  # of all windows of 1, 2, 4, ...
        self.pending = [np.zeros((0, 3), np.int64)]      # level, block, distance
        self.known: dict[tuple[int, int], int] = {}      # (start, period): end

    def append(self, values: np.ndarray) -> None:
        before = self.words.size
        self.words.add(values)
        for (start, period), end in self.known.items():
            if end == before:
                self.known[start, period] = self._right(end - period, period) + period
        # A period needs `repeat` times its length, so longer blocks have nothing to catch.
        limit = min(self.longest or self.words.size, self.words.size) // self.repeat
        level = 0
        while 2 * (1 << level) - 1 <= limit:
            self._advance(level)
            level += 1
        self._settle()

    def _advance(self, level: int) -> None:
        """Hash the new windows of a level and hold them against the blocks before them."""
        length = 1 << level
        if level == len(self.hashes):
            self.hashes.append(_Buffer(np.uint64))
        hashes = self.hashes[level]
        old, new = hashes.size, max(self.words.size - length + 1, hashes.size if level else 0)
        if level:
            below, half = self.hashes[level - 1].view, length // 2
            hashes.add(mixed(below[old:new] * _ODD + below[old + half:new + half]))
        else:
            hashes.add(mixed(self.words.view[old:new].view(np.uint64) + _ODD))
        view = hashes.view
        blocks = view[::length]
        for back in (2 * length - 1, 3 * length - 1):
            first = max(old, back)
            if first >= new:
                continue
            # The window at t meets block (t - back) // length.
            lo, hi = (first - back) // length, (new - 1 - back) // length + 1
            facing = np.repeat(blocks[lo:hi], length)[first - back - lo * length:][:new - first]
            t = np.flatnonzero(view[first:new] == facing) + first
            s = (t - back) // length * length
            self.pending.append(np.stack([np.full(len(t), level), s, t - s], 1))

    def _settle(self) -> None:
        """Confirm what is complete, level by level, and extend it to runs."""
        pending = np.concatenate(self.pending)
        level, s, q = pending.T
        complete = s + (self.repeat - 1) * q + (1 << level) <= self.words.size
        self.pending = [pending[~complete]]
        pending = pending[complete]
        for k in np.unique(pending[:, 0]).tolist():
            view, (_, s, q) = self.hashes[k].view, pending[pending[:, 0] == k].T
            for r in range(2, self.repeat):
                again = view[s + r * q] == view[s]
                s, q = s[again], q[again]
            # Only the largest distance of a level is a multiple of another one of it.
            last = q == 4 * (1 << k) - 2
            for part in (~last, last):
                self._extend(s[part], q[part], 1 << k)

    def _extend(self, s: np.ndarray, q: np.ndarray, length: int) -> None:
        """Compare the words around caught blocks, and keep the runs they lie in."""
        order = np.argsort(s, kind="stable")
        s, q = s[order], q[order]
        for (start, period), end in self.known.items():
            if end - start < 3 * length - 1 or not len(s):
                continue
            a, b = np.searchsorted(s, (start, end))
            inside = (s[a:b] + q[a:b] + length <= end) & (q[a:b] % period == 0)
            if inside.any():
                keep = np.ones(len(s), bool)
                keep[a:b] = ~inside
                s, q = s[keep], q[keep]
        order = np.lexsort((s, q))
        seen, until = 0, 0                     # the last stretch: its period and its end
        for block, period in zip(s[order].tolist(), q[order].tolist()):
            if period == seen and block + period <= until:
                continue
            start, end = self._left(block, period), self._right(block, period) + period
            if end - block - period < length:
                continue                       # equal hashes, other words
            seen, until = period, end
            if end - start >= self.repeat * period:
                self.known[start, period] = end
            elif end == self.words.size:       # still open: the next words may complete it
                self.pending.append(np.array([[length.bit_length() - 1, block, period]]))

    def _right(self, i: int, q: int) -> int:
        """The first place from i on whose word differs from that q later."""
        words, step = self.words.view, 16
        while i + q < len(words):
            same = words[i:i + step]
            other = words[i + q:i + q + step]
            differ = np.flatnonzero(same[:len(other)] != other)
            if len(differ):
                return i + int(differ[0])
            i, step = i + len(other), 2 * step
        return i

    def _left(self, i: int, q: int) -> int:
        """The first place from which on, up to i, all words equal those q later."""
        words, step = self.words.view, 16
        while i > 0:
            a = max(i - step, 0)
            differ = np.flatnonzero(words[a:i] != words[a + q:i + q])
            if len(differ):
                return a + int(differ[-1]) + 1
            i, step = a, 2 * step
        return i

    def runs(self) -> np.ndarray:
        """(start, length, period) of all runs so far, by start and then period."""
        found = np.array([(start, end - start, period)
                          for (start, period), end in self.known.items()], np.int64).reshape(-1, 3)
        found = found[found[:, 1] >= self.least]
        return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(documents: list[list[bytes]], least: int = LEAST,
            repeat: int = REPEAT) -> list[np.ndarray]:
    """The runs of each list of words."""
    sizes = [len(d) for d in documents]
    out: list[np.ndarray] = []
    for a, b in chunks([n + 1 for n in sizes], STREAM_WORDS):
        number: dict[bytes, int] = {}
        stream: list[int] = []
        for k, words in enumerate(documents[a:b]):
            stream += [number.setdefault(w, len(number)) for w in words]
            stream.append(-1 - k)
        catcher = SquareCatcher(least, repeat, max(sizes[a:b]))
        catcher.append(np.array(stream, np.int64))
        found = catcher.runs()
        starts = np.cumsum([0, *(n + 1 for n in sizes[a:b])])
        cuts = np.searchsorted(found[:, 0], starts)
        out += [found[i:j] - [s, 0, 0] for i, j, s in zip(cuts, cuts[1:], starts)]
    return out


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repetition: a tail of one document in ten becomes periodic."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, found[:, 0] + found[:, 2], 1)
    np.add.at(gone, found[:, 0] + found[:, 1], -1)
    inside = np.cumsum(gone)[:-1] > 0
    return [w for w, out in zip(words, inside.tolist()) if not out] if inside.any() else words


def strongest(found: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties go to the first, then the shorter."""
    best = None
    for run in found.tolist():
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = tuple(run)
    return best


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string, runs array<array<long>>, "
          "collapsed binary")


def detect(docs: DataFrame, least: int = LEAST, repeat: int = REPEAT,
           plant: bool = False) -> DataFrame:
    """Per document its runs, the strongest one, and the text without repetitions."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = [t.split() for t in byte_texts(batch)]
            if plant:
                documents = [planted(i, w) for i, w in zip(
                    batch.column("doc_id").to_pylist(), documents)]
            out = []
            for words, found in zip(documents, runs_of(documents, least, repeat)):
                top = strongest(found)
                text = b" ".join(collapsed(words, found))
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in found.tolist())
                out.append((len(found), *(top or (None,) * 3),
                            top and 1000 * top[1] // top[2],
                            hashlib.sha256(listed.encode()).hexdigest(),
                            hashlib.sha256(text).hexdigest(), found.tolist(), text))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(),
                     pa.list_(pa.list_(pa.int64())), pa.binary())
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return keyed(docs).select("doc_id", "text").mapInArrow(work, SCHEMA)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), plant=True).drop("runs", "collapsed")
