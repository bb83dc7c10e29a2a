"""Operators 3 and 8 against counting every window in one place."""

import hashlib
from collections import Counter

import pytest

from folioscope.llm import op3_substrings, op8_suffixes
from tests.llm import corpus


def expected(rows, split, join, window):
    units = [split((t or "").encode()) for _, t in rows]
    windows = Counter(tuple(u[i:i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for (doc, _), u in zip(rows, units):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if windows[tuple(u[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = join([x for x, g in zip(u, gone) if not g])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("window, buckets", [(35, 1 << 30), (35, 3000), (8, 9000)])
def test_words(spark, window, buckets):
    docs = corpus.documents(spark)
    want = expected(rows_of(docs), bytes.split, b" ".join, window)
    got = op3_substrings.remove(docs, window, buckets)
    assert corpus.bag(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(
        ((d, n, r, s) for d, n, r, _, s in want), key=repr)
    assert any(r for _, _, r, _, _ in want) and any(not r for _, n, r, _, _ in want if n > 50)


@pytest.mark.parametrize("window, gram, buckets, hot", [
    (400, 32, 1 << 30, 4096), (400, 32, 5000, 2), (100, 16, 5000, 4096), (100, 16, 20000, 0)])
def test_bytes(spark, window, gram, buckets, hot):
    docs = corpus.documents(spark)
    want = expected(rows_of(docs), list, bytes, window)
    got = op8_suffixes.remove(docs, window, gram, buckets, hot)
    assert corpus.bag(got, "doc_id", "n_bytes", "n_removed", "n_spans",
                      "kept_sha256") == sorted(want, key=repr)


def test_empty(spark):
    assert op3_substrings.remove(corpus.empty(spark)).count() == 0
    assert op8_suffixes.remove(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("window", [3, 8, 9, 17])
def test_suffix_array_finds_all_repeated_windows(window):
    import random
    rng = random.Random(window)
    for _ in range(40):
        letters = b"ab\0"[:rng.randint(1, 3)]
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(window, 60)))
                   for _ in range(rng.randint(1, 6))]
        counts = Counter(s[i:i + window] for s in strings for i in range(len(s) - window + 1))
        for s, found in zip(strings, op8_suffixes.repeated_windows(strings, window)):
            assert found.tolist() == [counts[s[i:i + window]] > 1
                                      for i in range(len(s) - window + 1)]


def test_suffixes_come_out_in_order():
    import numpy as np
    text = b"mississippi\0missing\0"
    ends = np.array([11, 19])
    order = op8_suffixes.suffix_array(np.frombuffer(text, np.uint8), ends, 16)
    suffixes = [text[i:].split(b"\0")[0] for i in order]
    assert sorted(order.tolist()) == list(range(20))
    assert suffixes[2:] == sorted(suffixes[2:])
