"""Operator 4 against comparing all pairs."""

import numpy as np
import pytest
import xxhash

from folioscope.llm import op4_near_dedup as op4
from folioscope.llm.components import components
from tests.llm import corpus


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_groups(rows, radius=4):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return prints, [find(i) for i in range(len(rows))], [least.get(find(i)) for i in range(len(rows))]


def test_groups(spark):
    docs = corpus.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints, _, ids = plain_groups(rows)
    got = op4.near_groups(docs)
    assert corpus.bag(got.selectExpr("doc_id", "lower(lpad(hex(fingerprint), 16, '0')) f",
                                     "component_id"), "doc_id", "f", "component_id") == sorted(
        ((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, ids)), key=repr)


def test_keep_one(spark):
    docs = corpus.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, roots, _ = plain_groups(rows)
    kept = op4.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert op4.keep_one(corpus.empty(spark)).count() == 0
    assert op4.near_groups(corpus.empty(spark)).count() == 0


@pytest.mark.parametrize("chunk", [8192, 50])
def test_no_link_is_lost(spark, chunk):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = set(rng.integers(0, 1 << 63, 300, dtype=np.uint64).tolist())
    for seed in seeds.tolist():             # chains and clouds around a few centres
        for _ in range(40):
            seed ^= 1 << int(rng.integers(64))
            prints.add(seed)
            prints.add(seed ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64)))
    values = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(v,) for v in values], "fingerprint long").repartition(4)
    links = op4.links(table, chunk=chunk)
    named = dict(components(links).collect())
    got = [named.get(v, v) for v in values]
    want = plain_roots(np.array(values).view(np.uint64))
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


def plain_roots(prints):
    root = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    while True:
        new = np.where(near, root[None, :], len(root)).min(1)
        if (new == root).all():
            return root.tolist()
        root = new


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = components(spark.createDataFrame(rows, "a long, b long"))
    assert sorted(got.collect()) == sorted([(i, 0) for i in range(1, 61)]
                                           + [(100 + i, 100) for i in range(1, 50)])
