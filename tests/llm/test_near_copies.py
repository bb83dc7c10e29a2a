"""The near copies of the pipeline against the exact similarity of all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import near_copies
from tests.llm import corpus


def plain_roots(texts):
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 9 * shared >= 4 * (len(sets[i]) + len(sets[j])):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def copies(seed=3, groups=30):
    """Texts and copies of them with one to many words replaced."""
    rng, out = random.Random(seed), []
    for _ in range(groups):
        words = corpus.prose(rng, rng.randint(100, 600)).split(" ")
        out.append(" ".join(words))
        for _ in range(6):
            near = list(words)
            for k in rng.sample(range(len(near)), max(1, int(len(near) * rng.uniform(0, 0.035)))):
                near[k] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(near))
    return out


def test_groups(spark):
    texts = copies() + corpus.texts()
    docs = corpus.documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
    want = plain_roots(texts)
    assert len(set(got.values())) == len(set(want))
    assert len({(got[i], w) for i, w in enumerate(want)}) == len(set(want))


def test_stage_keeps_one_of_each(spark):
    texts = copies(seed=4, groups=12)
    docs = corpus.documents(spark, list(enumerate(texts)))
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    want = {}
    for i, root in enumerate(plain_roots(texts)):
        want.setdefault(root, i)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want.values())
    assert near_copies.keep_one(corpus.empty(spark)).count() == 0
    odd = corpus.documents(spark, [(None, None), (3, " "), (5, ""), (7, "a b"), (8, "A  b"), (9, "a")])
    assert {r.doc_id for r in near_copies.keep_one(odd).collect()} == {3, 7, 9}


def test_a_cloud_of_texts_that_are_nearly_similar(spark, monkeypatch):
    """All pairs of the cloud are candidates, few are links; chunks and tiles are small."""
    rng = random.Random(6)
    words = corpus.prose(rng, 240).split(" ")
    texts = []
    for i in range(60):
        near = list(words)
        for k in rng.sample(range(len(near)), 2 if i % 20 == 0 else 3 + (i % 3 == 0)):
            near[k] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    monkeypatch.setattr(near_copies, "CHUNK", 16)
    docs = corpus.documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r.root for r in near_copies.near_copies(docs).collect()}
    want = plain_roots(texts)
    assert 1 < len(set(want)) < 40
    assert len({(got[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(got.values()))


def test_fingerprints_find_near_copies_on_their_own(spark):
    """No two texts agree in a band of min-hashes here, so all links come from SimHash."""
    rng, texts = random.Random(8), []
    for _ in range(15):
        words = corpus.prose(rng, 500).split(" ")
        texts += [" ".join(words), " ".join(words[:-1] + ["other"])]
    docs = corpus.documents(spark, list(enumerate(texts)))
    rows = near_copies.signatures(docs).withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    nodes = rows.withColumn("bands", F.transform("bands", lambda b: F.xxhash64("node", b)))
    place = {r.node: r.id for r in rows.collect()}
    got = {tuple(sorted((place[r.a], place[r.b])))
           for r in near_copies.near_links(docs, nodes).collect()}
    assert got <= {(i, i + 1) for i in range(0, 30, 2)} and len(got) >= 10
