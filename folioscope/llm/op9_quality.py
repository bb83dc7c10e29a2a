"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages of fixed width that cover the whole text. Every
passage is encoded (shares of kinds of characters, hashed pairs of characters, lines
seen before, words said twice in a row, then a learned layer). Gated attention gives each passage
a weight, and the weighted sum of the codes is scored. All weights are learned from
document labels alone.

An empty or null text is one empty passage and gets a score like any other. Repeated
rows and null IDs are scored like others (a null ID has no remainder and counts as not
held out). Without labels of both kinds the score is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import byte_texts, chunks, labelled_sample, prepare, table

PASSAGE = 400
_SINGLE = b" \n\t!|#*$%&<>.,;:?'\"()=_-/+@"
_CLASS = np.full(256, 0, np.uint8)                       # 0: other
for _i, _c in enumerate(_SINGLE):
    _CLASS[_c] = 5 + _i
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 4
_N_CLASS = 5 + len(_SINGLE)
_PAIRS = 32
DIM = _N_CLASS + _PAIRS + 3


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and how many each text has."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.concatenate([[0], np.cumsum(sizes)])
    # The passage of every byte: its text's first passage plus its place in the text.
    place = np.arange(len(data)) - np.repeat(start[:-1], sizes)
    owner = np.repeat(first[:-1], sizes) + place // PASSAGE
    total = int(first[-1])
    kinds = _CLASS[data]
    shares = np.bincount(owner * _N_CLASS + kinds,
                         minlength=total * _N_CLASS).reshape(total, _N_CLASS).astype(np.float32)
    length = np.maximum(shares.sum(1, keepdims=True), 1)
    pair = (data[:-1].astype(np.uint32) * 257 + data[1:]) * np.uint32(2654435761) >> np.uint32(27)
    pairs = np.bincount(owner[:-1] * _PAIRS + pair,
                        minlength=total * _PAIRS).reshape(total, _PAIRS).astype(np.float32)
    seen = np.zeros((total, 2), np.float32)
    for i, text in enumerate(texts):
        for k in range(counts[i]):
            words = text[k * PASSAGE:(k + 1) * PASSAGE].split()
            seen[first[i] + k, 1] = sum(map(eq, words, words[1:])) / max(len(words), 1)
        lines, at = set(), 0
        for line in text.split(b"\n"):
            if len(line) > 1:
                if line in lines:
                    a, b = first[i] + at // PASSAGE, first[i] + (at + len(line) - 1) // PASSAGE
                    seen[a:b + 1, 0] += len(line) / (b + 1 - a) / PASSAGE
                lines.add(line)
            at += len(line) + 1
    return np.hstack([np.sqrt(shares / length), pairs / length * 8, seen,
                      length / PASSAGE]), counts


@dataclass
class Network:
    """Encoder, gate and score; `parts` are the learned arrays."""

    parts: dict

    @staticmethod
    def fresh(width: int, gate: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        return Network({"encode": normal(DIM, width), "encode_0": np.zeros(width),
                        "value": normal(width, gate), "gate": normal(width, gate),
                        "weigh": normal(gate, 1)[:, 0], "score": normal(width, 1)[:, 0],
                        "score_0": np.zeros(1)})

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p = self.parts
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        code = np.tanh(x @ p["encode"] + p["encode_0"])
        value, gate = np.tanh(code @ p["value"]), 1 / (1 + np.exp(-(code @ p["gate"])))
        logit = (value * gate) @ p["weigh"]
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, at), counts))
        a = e / np.repeat(np.add.reduceat(e, at), counts)
        bag = np.add.reduceat(a[:, None] * code, at)
        y = 1 / (1 + np.exp(-(bag @ p["score"] + p["score_0"][0])))
        return {"code": code, "value": value, "gate": gate, "a": a, "bag": bag, "y": y}

    def gradient(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict:
        p, f = self.parts, self.forward(x, counts)
        at = np.concatenate([[0], np.cumsum(counts)[:-1]])
        d = (f["y"] - labels) / len(labels)
        d_bag = np.repeat(d[:, None] * p["score"], counts, axis=0)
        d_a = (d_bag * f["code"]).sum(1)
        d_logit = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, at), counts))
        d_mix = d_logit[:, None] * p["weigh"]
        d_value = d_mix * f["gate"] * (1 - f["value"] ** 2)
        d_gate = d_mix * f["value"] * f["gate"] * (1 - f["gate"])
        d_code = f["a"][:, None] * d_bag + d_value @ p["value"].T + d_gate @ p["gate"].T
        d_pre = d_code * (1 - f["code"] ** 2)
        return {"encode": x.T @ d_pre, "encode_0": d_pre.sum(0), "value": f["code"].T @ d_value,
                "gate": f["code"].T @ d_gate, "weigh": (f["value"] * f["gate"]).T @ d_logit,
                "score": f["bag"].T @ d, "score_0": np.array([d.sum()])}


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, width: int = 24, gate: int = 12,
          epochs: int = 60, bags: int = 64, rate: float = 0.004, seed: int = 9) -> Network:
    """Adam over shuffled groups of bags."""
    net, rng = Network.fresh(width, gate, seed), np.random.default_rng(seed)
    first = np.concatenate([[0], np.cumsum(counts)])
    m = {k: np.zeros_like(v) for k, v in net.parts.items()}
    v = {k: np.zeros_like(p) for k, p in net.parts.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), bags):
            pick = order[i:i + bags]
            rows = np.concatenate([np.arange(first[j], first[j + 1]) for j in pick])
            grad, step = net.gradient(x[rows], counts[pick], labels[pick]), step + 1
            pace = rate * (1 - epoch / epochs) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for k, g in grad.items():
                g = g + 1e-4 * net.parts[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.parts[k] = net.parts[k] - pace * m[k] / (v[k] ** 0.5 + 1e-8)
    return net


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000,
        max_passages: int = 256) -> Network | None:
    """Learn from at most `sample_rows` labelled documents that are not held out.

    Of a document of more than `max_passages` passages, so many are learned from, evenly
    spread over it (all are scored), so what reaches the driver is bounded.
    """
    sample = labelled_sample(docs, labels.filter(~held_out("doc_id")), sample_rows, 9)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, counts = passages(byte_texts(batch))
            kept = [np.linspace(e - c, e - 1, min(c, max_passages)).astype(int)
                    for e, c in zip(np.cumsum(counts), counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"),
                 pa.array([len(k) for k in kept], pa.int64()),
                 pa.array([x[k].astype(np.float32).tobytes() for k in kept], pa.binary())],
                names=["doc_id", "label", "n", "x"])
    rows = sample.mapInArrow(work, "doc_id long, label int, n long, x binary").toPandas()
    rows = rows.sort_values(["doc_id", "n"], kind="stable")
    if rows["label"].nunique() < 2:
        return None
    x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, DIM) for b in rows["x"]])
    return train(x, rows["n"].to_numpy(), rows["label"].to_numpy(float))


def scored(docs: DataFrame, net: Network | None, *carry: str, name: str = "score") -> DataFrame:
    """The columns to carry and the score, for every row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch)
            score = np.ones(len(texts))
            for a, b in chunks([len(t) for t in texts], 1 << 20) if net else ():
                x, counts = passages(texts[a:b])
                score[a:b] = net.forward(x, counts)["y"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(score)], names=[*carry, name])
    prepare(docs.sparkSession)
    schema = "".join(f"`{n}` {t}, " for n, t in docs.select(*carry).dtypes)
    source = docs.select(*carry, *(() if "text" in carry else ("text",)))
    return source.mapInArrow(work, schema + f"`{name}` double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, net, "doc_id").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
