"""Operator 6: ids against the tokenizers library, packing against its own rules."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import op6_packing as op6
from tests.llm import corpus

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("aAé \n\t'sr7.,!|中😀 \u200b", max_size=60))
def test_same_ids(text):
    from tokenizers import Tokenizer
    mine = op6.encoder().encode_ordinary(text)
    test_same_ids.known = getattr(test_same_ids, "known", None) or Tokenizer.from_file(
        public_tokenizers.path("byte_bpe_50k.json"))
    test_same_ids.known.encode_special_tokens = True
    assert mine == test_same_ids.known.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "é", "'s"]),
                max_size=12).map("".join))
def test_added_tokens(text):
    assert op6.token_ids()(text) == op6.library().encode(text, add_special_tokens=False).ids


def test_end_of_text_is_one_token(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x" + " " * 1_200_000 + "y<|endoftext|>"]
    assert op6.token_ids()(texts[0]) == [64, 220, 50256, 275]
    want = []
    for k, text in enumerate(texts):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        want.append((k, first, zlib.crc32(np.array(ids[:first], "<u4").tobytes())))
    packed = op6.pack(corpus.documents(spark, list(enumerate(texts)))).filter("piece = 0")
    assert corpus.bag(packed, "doc_id", "length", "ids_crc32") == want


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", " \t"])
def test_a_very_long_run_of_blanks(spark, tokenizer, blank):
    text = "a b" + blank * (1_200_000 // len(blank)) + "x y"
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    docs = corpus.documents(spark, [(1, text), (2, "c")])
    got = {r.doc_id: r.n for r in op6.pack(docs).groupBy("doc_id").agg(
        op6.F.sum("length").alias("n")).collect()}
    assert got == {1: len(ids), 2: 2}
    assert op6.token_ids()(text) == ids[:-1]


@pytest.mark.parametrize("capacity, group_rows", [(1024, 16384), (64, 20)])
def test_pieces(spark, tokenizer, capacity, group_rows):
    docs = corpus.documents(spark)
    want = []
    for row in docs.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        short = len(ids) % capacity if len(ids) > capacity else len(ids)
        edges = sorted({0, *range(short, len(ids), capacity), len(ids)})
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((row.doc_id, k, a, b - a,
                         zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    packed = op6.pack(docs, capacity, group_rows)
    assert corpus.bag(packed, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(
        want, key=repr)
    sequences = defaultdict(list)
    for row in packed.collect():
        sequences[row.sequence_id].append((row.offset, row.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    groups = -(-docs.count() // group_rows)
    assert len(sequences) <= total / capacity * 1.1 + 2 * groups
    assert op6.pack(corpus.empty(spark)).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(1, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 60)))
        bin_of, offset, opened = op6.best_fit_decreasing(lengths, capacity)
        room, plain = [], np.zeros(len(lengths), int)
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(r, k) for k, r in enumerate(room) if r >= lengths[i]]
            if not fits:
                room.append(capacity)
                fits = [(capacity, len(room) - 1)]
            plain[i] = min(fits)[0] - lengths[i]
            room[min(fits)[1]] -= lengths[i]
        assert opened == len(room)
        left = capacity - offset - lengths
        assert sorted(left.tolist()) == sorted(plain.tolist())


def test_exact_ids_beside_null_and_equal_rows(spark, tokenizer):
    """IDs above 2^53 beside null ones; one row a third of all is dealt over all groups."""
    ids = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1]
    rows = [(i, f"text {i}") for i in ids] + [(5, "one and the same row")] * 300
    got = op6.pack(corpus.documents(spark, rows), group_rows=64).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 32] += 1
    assert len(groups) == 5 and max(groups.values()) <= 64 + 8
    assert op6.pack(corpus.empty(spark)).count() == 0
