"""Operator 1 against looking for every window at every place."""

import hashlib
import random
import re

import pytest

from folioscope.llm import op1_decontamination as op1
from tests.llm import corpus

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(rows, items, window=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in wanted}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wanted:
                    hit |= set(range(i, i + size))
                    found |= wanted[tuple(w[i:i + size])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names),
                    hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def benchmark(spark, seed=2):
    rng = random.Random(seed)
    texts = [t for t in corpus.texts() if t and len(t.split()) > 30]
    items = []
    for i in range(30):
        w = rng.choice(texts).split()
        a = rng.randrange(len(w) - 20)
        items.append((i, " ".join(w[a:a + rng.choice([1, 2, 5, 9, 10, 11, 25])]).upper()
                      if i % 2 else " ".join(w[a:a + 14])))
    items += [(3, items[5][1]), (40, None), (41, " .. "), (42, "É é É É É é é é é é é"),
              (None, items[7][1]), (43, items[6][1] + " and more"),
              (44, corpus.prose(rng, 300) + " " + texts[9])]
    return spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hits int"), items


@pytest.mark.parametrize("shard_words", [100_000, 60])
def test_hits(spark, shard_words):
    docs, (table, items) = corpus.documents(spark), benchmark(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = op1.summary(op1.matched(docs.select("doc_id", "text"), table, 10, shard_words))
    got = corpus.bag(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                     "contaminated")
    assert got == expected(rows, items)
    assert sum(r[-1] for r in got) > 5 and not all(r[-1] for r in got)


def test_clean_leaves_no_window_and_no_clean_document_changes(spark):
    docs, (table, items) = corpus.documents(spark), benchmark(spark)
    before = expected([(r.doc_id, r.text) for r in docs.collect()], items)
    clean = op1.clean(docs, table)
    assert clean.columns == docs.columns
    after = [(r.doc_id, r.text) for r in clean.collect()]
    assert not any(r[-1] for r in expected(after, items))
    hit = {r[0] for r in before if r[-1]}
    untouched = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in hit]
    assert sorted(untouched, key=repr) == sorted((r for r in after if r[0] not in hit), key=repr)


def test_words_that_a_cut_brings_together_are_seen(spark):
    item = " ".join(f"w{i}" for i in range(10))
    inner = "w0 w1 w2 " + item + " w3 w4 w5 w6 w7 w8 w9 tail of text that is long enough to stay"
    docs = spark.createDataFrame([(1, inner)], "doc_id long, text string")
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert op1.clean(docs, table, 0.99).collect()[0].text.split()[0] == "tail"


def test_empty(spark):
    table = benchmark(spark)[0]
    docs = corpus.documents(spark)
    assert op1.clean(corpus.empty(spark), table).count() == 0
    none = op1.summary(op1.matched(docs.select("doc_id", "text"), table.limit(0)))
    assert none.count() == docs.count() and none.filter("contaminated").count() == 0
