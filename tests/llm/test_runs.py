"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from folioscope.llm import op11_runs
from tests.llm import corpus


def plain_runs(words, least=6, repeat=4):
    n, out = len(words), []
    for q in range(1, n // repeat + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, repeat * q):
                smaller = any(all(words[k] == words[k + p] for k in range(i, j + q - p))
                              for p in range(1, q))
                if not smaller:
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def strings(rng, n):
    """Texts of few letters, of repeated units, and of units within units."""
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            yield [rng.choice("ab") for _ in range(rng.randrange(120))]
        elif kind == 1:
            yield [rng.choice("abc") for _ in range(rng.randrange(9))] * rng.randrange(14)
        elif kind == 2:
            unit = [rng.choice("ab") for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 7)
            yield (unit + [rng.choice("abz")]) * rng.randrange(1, 8)
        else:
            yield ([rng.choice("abc") for _ in range(7)] + ["x"] * rng.randrange(90)
                   + [rng.choice("xy") for _ in range(20)])


@pytest.mark.parametrize("least,repeat", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_many_texts(least, repeat):
    rng = random.Random(repeat)
    texts = [[w.encode() for w in t] for t in strings(rng, 400)]
    got = op11_runs.runs_of(texts, least, repeat)
    for words, found in zip(texts, got):
        assert [tuple(r) for r in found.tolist()] == plain_runs(words, least, repeat), words


@pytest.mark.parametrize("repeat", [2, 4])
def test_words_appended_one_by_one_or_in_parts(repeat):
    rng = random.Random(9)
    for words in strings(rng, 60):
        values = np.array([ord(w) for w in words], np.int64)
        for step in (1, 5, 33):
            catcher = op11_runs.SquareCatcher(2, repeat)
            for i in range(0, len(values), step):
                catcher.append(values[i:i + step])
                seen = [tuple(r) for r in catcher.runs().tolist()]
            if len(values):
                assert seen == plain_runs(words, 2, repeat)


def test_one_repeated_word_costs_no_more_than_another_text():
    many = [b"a"] * 1_000_000
    (found,) = op11_runs.runs_of([many])
    assert found.tolist() == [[0, 1_000_000, 1]]
    (found,) = op11_runs.runs_of([([b"a"] * 999 + [b"b"]) * 300])
    assert [0, 300_000, 1000] in found.tolist() and len(found) == 301


def plain(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    top = best[0] if best else (None,) * 3
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if best else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest())


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(corpus.texts()) if t is None or len(t) < 4000]
    rows += [(i, " ".join(f"w{k % 90}" for k in range(60 + i % 50))) for i in range(100, 220)]
    rows += [(None, "a a a a a a a b"), (None, None), (7, "x y " * 20), (7, "x y " * 20)]
    corpus.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_runs.op11_runs(spark, str(tmp_path))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256")
    assert sum(r.n_runs > 0 for r in got.collect()) > 8
    assert corpus.bag(got, *names) == sorted((plain(*r) for r in rows), key=repr)
    assert op11_runs.detect(corpus.empty(spark)).count() == 0


def test_real_outputs(spark):
    docs = corpus.documents(spark, [(1, "go on and on and on and on and on then stop")])
    row = op11_runs.detect(docs).first()
    assert row.runs == [[1, 9, 2]] and row.collapsed.decode() == "go on and then stop"
