"""Operators 7 and 9: counts against plain ones, models on held-out labels."""

import random
import re
import zlib

import numpy as np

from folioscope.llm import op7_quality_rules as op7
from folioscope.llm import op9_quality as op9
from folioscope.llm.shared import labelled_sample
from tests.llm import corpus

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = BLANK.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup,
            len(hit))


def labelled(spark, n=500, seed=4):
    """Prose, of which a part is junk; labels for most, some of them odd."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        text = corpus.prose(rng, rng.randint(60, 300))
        good = rng.random() < 0.7
        if not good:
            text = (re.sub(" ", " ### ", text) if i % 2 else text.upper().replace(" ", "!! "))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (3, labels[3][1], 0), (10_000, 1, 0), (11, None, None)]
    return (corpus.documents(spark, rows + [(None, "short"), (n, None), (n + 1, "")]),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_counts_and_rules(spark):
    docs = corpus.documents(spark, [r for r in enumerate(corpus.texts())
                                    if len(r[1] or "") < 9000] + [(None, "#a b|c\n#a b|c\n")])
    want = []
    for row in docs.collect():
        counts = plain_counts(row.text)
        want.append((row.doc_id, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    got = op7.judge(docs, None)
    assert corpus.bag(got, "doc_id", *op7.COUNTS, "base_failed") == sorted(want, key=repr)
    assert got.filter("kept = base_failed").count() == 0
    assert op7.judge(corpus.empty(spark), None).count() == 0


def test_trees_follow_labels_and_constraints(spark):
    docs, labels = labelled(spark)
    trees = op7.fit(docs, labels)
    got = {r.doc_id: r for r in op7.judge(docs, trees).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    both = [(got[i].kept, truth[i]) for i in got if i in truth]
    assert np.mean([k == bool(q) for k, q in both]) > 0.95
    x = np.random.default_rng(0).random((200, len(op7.FEATURES)))
    for name, sign in op7.MONOTONE.items():
        last = None
        for value in np.linspace(0, 1, 15):
            x[:, op7.FEATURES.index(name)] = value
            score = trees.score(x)
            assert last is None or (sign * (score - last) >= -1e-12).all()
            last = score
    assert op7.fit(docs, labels.limit(0)) is None


def test_flat_trees_score_like_walking_them():
    rng = np.random.default_rng(2)
    x = rng.random((300, 4))
    trees = op7.grow(x, (x[:, 0] + x[:, 1] > 1).astype(float), np.array([1, 0, 0, 0]), trees=20)
    for row, score in zip(x[:40], trees.score(x[:40])):
        margin = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                below = row[trees.feature[at]] <= trees.threshold[at]
                at = trees.left[at] if below else trees.right[at]
            margin += trees.value[at]
        assert abs(1 / (1 + np.exp(-margin)) - score) < 1e-12


def test_held_out_quality(spark):
    docs, labels = labelled(spark)
    net = op9.fit(docs, labels)
    got = op9.scored(docs, net, "doc_id").withColumn("held_out", op9.held_out("doc_id")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    for row in got:
        assert row.held_out == (row.doc_id is not None
                                and zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    both = [((r.score >= 0.3), truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(both) > 50 and np.mean([k == bool(q) for k, q in both]) > 0.95
    assert op9.fit(docs, labels.limit(0)) is None
    assert op9.scored(corpus.empty(spark), net, "doc_id").count() == 0
    assert {r.score for r in op9.scored(docs, None, "doc_id").collect()} == {1.0}


def test_passages_cover_the_whole_text():
    texts = [b"", b"a" * 399, b"b" * 400, b"c" * 401, b"\xc3\xa9" * 1000]
    x, counts = op9.passages(texts)
    assert counts.tolist() == [1, 1, 1, 2, 5] and len(x) == 10 and np.isfinite(x).all()


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    net = op9.Network.fresh(5, 3, 0)
    x, counts = rng.random((9, op9.DIM)), np.array([2, 3, 4])
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        y = net.forward(x, counts)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))
    grad = net.gradient(x, counts, labels)
    for name, part in net.parts.items():
        flat, at = part.reshape(-1), int(rng.integers(part.size))
        flat[at] += 1e-6
        up = loss()
        flat[at] -= 2e-6
        down = loss()
        flat[at] += 1e-6
        assert abs((up - down) / 2e-6 - grad[name].reshape(-1)[at]) < 1e-6


def test_a_document_of_many_rows_is_one_of_the_sample(spark):
    rows = [(1, "the same row again and again")] * 40_000 + [(2, "another"), (1, None), (None, "x")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 0)],
                                   "doc_id long, quality int")
    got = labelled_sample(corpus.documents(spark, rows), labels, 4000, 7).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (2, 0)]


def test_long_documents_are_learned_from_too(spark):
    docs, labels = labelled(spark, 200)
    long = docs.withColumn("text", op9.F.repeat("text", 30))
    net = op9.fit(long, labels, max_passages=8)
    rows = op9.scored(long, net, "doc_id").join(labels, "doc_id").filter("quality is not null")
    right = [(r.score >= 0.3) == r.quality for r in rows.collect()]
    assert sum(right) > 0.9 * len(right)
