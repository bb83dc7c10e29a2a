"""Quality rules: counts of each text, and boosted trees over statistics made from them.

The trees are grown here, in numpy, on histograms of a bounded sample of labelled
documents, with constraints: the score may not rise with the share of symbols, of
repeated lines or of repeated words. They are flattened into arrays of nodes, and a
batch is scored by stepping all its rows down all trees at once.

Null and empty texts have no words, so all counts are 0 and base_failed is true.
Repeated rows and null IDs are judged like others. Without labels of both kinds there
is no model and the base rules decide alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.shared import byte_texts, labelled_sample, prepare, table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits",
            "marks", "bars", "distinct")
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1}
_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\v\f\r"
_KIND = np.zeros(256, np.uint8)
_KIND[np.frombuffer(_BLANK, np.uint8)] = 1
_KIND[np.frombuffer(_SYMBOLS, np.uint8)] = 2
_KIND[0x41:0x5B] = 3
_KIND[0x30:0x3A] = 4
_KIND[np.frombuffer(b"!?.,;:", np.uint8)] = 5
_KIND[0x80:0xC0] = 6      # all but the first byte of a longer code point
_KIND[ord("|")] = 7


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = reach = 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, reach)
            reach = i + 3
    return covered


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """The five counts of a text, and the features made of them and of its characters."""
    words = text.split()
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)
    chars = len(text) - int(kinds[6]) - int(kinds[1])
    symbols = int(kinds[2] + kinds[7])
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    n = len(words)
    repeats = repeat_words(words)
    d, c = max(n, 1), max(chars, 1)
    return ([n, chars, symbols, dup_lines, repeats],
            [float(np.log1p(n)), chars / d, symbols / c, dup_lines / max(len(lines), 1),
             repeats / d, kinds[3] / c, kinds[4] / c, kinds[5] / c, kinds[7] / c,
             len(set(words)) / d])


@dataclass(frozen=True)
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(below, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3,
         rate: float = 0.15, bins: int = 32, leaf: float = 4.0, ridge: float = 1.0) -> Trees:
    """Boost depth-limited trees on the logistic loss, split on quantile bins.

    A split on a constrained feature must keep its sides in order, and its middle value
    becomes a bound of both, so deeper splits keep the order as well.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
            for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    nodes: list[list[float]] = []          # feature, threshold, left, right, value
    roots = []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float,
              level: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        me = len(nodes)
        nodes.append([0, np.inf, me, me, rate * float(np.clip(-gs / (hs + ridge), low, high))])
        if level == depth:
            margin[rows] += nodes[me][4]
            return me
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            gl = np.cumsum(np.bincount(codes[rows, j], g[rows], len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, j], h[rows], len(cut) + 1))[:-1]
            a = np.clip(-gl / (hl + ridge), low, high)
            b = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
            whole = np.clip(-gs / (hs + ridge), low, high)
            loss = lambda v, gg, hh: gg * v + 0.5 * (hh + ridge) * v * v
            gain = loss(whole, gs, hs) - loss(a, gl, hl) - loss(b, gs - gl, hs - hl)
            fits = (hl >= leaf * 0.1) & (hs - hl >= leaf * 0.1) & (monotone[j] * (b - a) >= 0)
            gain = np.where(fits, gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(a[k]), float(b[k]))
        _, j, k, a, b = best
        if j < 0:
            margin[rows] += nodes[me][4]
            return me
        middle = (a + b) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)),
                  0: ((low, high), (low, high))}[int(monotone[j])]
        is_left = codes[rows, j] <= k
        left = split(rows[is_left], g, h, *bounds[0], level + 1)
        right = split(rows[~is_left], g, h, *bounds[1], level + 1)
        nodes[me][:4] = [j, float(cuts[j][k]), left, right]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(split(np.arange(len(y)), p - y, p * (1 - p), -4.0, 4.0, 0))
    flat = np.array(nodes)
    return Trees(np.array(roots), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int),
                 flat[:, 3].astype(int), flat[:, 4], depth, start)


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """The features of every row, beside the columns named."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry),
                 pa.array([f for _, f in rows], pa.list_(pa.float64()))],
                names=[*carry, "features"])
    schema = "".join(f"{n} {t}, " for n, t in docs.select(*carry).dtypes)
    return docs.select(*carry, "text").mapInArrow(work, schema + "features array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> Trees | None:
    """Trees from at most `sample_rows` labelled documents; None without both labels."""
    rows = measured(labelled_sample(docs, labels, sample_rows, 7), "doc_id", "label").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if rows["label"].nunique() < 2:
        return None
    return grow(np.array(rows["features"].tolist()), rows["label"].to_numpy(float),
                np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def judge(docs: DataFrame, trees: Trees | None, least_score: float = 0.3) -> DataFrame:
    """Counts and verdict of every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in byte_texts(batch)]
            counts = np.array([c for c, _ in rows], np.int64).reshape(-1, 5)
            x = np.array([f for _, f in rows], float).reshape(-1, len(FEATURES))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            score = trees.score(x) if trees and len(x) else np.ones(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts.T.copy()),
                 pa.array(failed), pa.array(~failed & (score >= least_score)),
                 pa.array(score)],
                names=["doc_id", *COUNTS, "base_failed", "kept", "score"])
    prepare(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
        + ", base_failed boolean, kept boolean, score double")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
