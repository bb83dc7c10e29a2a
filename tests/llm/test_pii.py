"""Operator 10 against plain patterns and against statistics computed in Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

from folioscope.llm import op10_pii as op10
from tests.llm import corpus

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LETTER = r"[^\W\d_]"
WORD = re.compile(rf"(?<=[^\w.%+@-]){LETTER}+(?=[^\w%+@-])(?!\.\w)")
TEXTS = [
    "mail a.b+c@d-e.co.uk, x@y, z@q..r, a@b.c_d@e.fr %@h.i a@b.c@d.e",
    "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5 and 00000255.0.0.1 1.2.3.4567 11.22.33.44.55.66.77.88",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "cards 79927398713 0000000000000 000000000000-0000000 00000000000000000000 4242424242424242x",
    "phone +1 (212) 555-0100. +49.30.1234567 +123 +1234567890123456 ++4915112345678 +4 5-5-5-5-5-5-5-5-",
    "é 😀 a@b.co 😀 +33 1 23 45 67 89 é 10.0.0.1é 5500 0000 0000 0004", None, "", "a" * 100_000,
    "1" * 5_000 + " " + "a.b" * 1_500 + "@", "1.2." * 20_000, "+1 2" * 5_000,
]


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            n = int(c) * (1 + i % 2)
            total += n - 9 if n > 9 else n
        return total % 10 == 0
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text)
              if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text)
              if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{op10.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def leaky(seed=6):
    """Documents in which one word is only ever near one address."""
    rng, rows = random.Random(seed), []
    for i in range(60):
        text = corpus.prose(rng, 60)
        if i % 6 == 0:
            text += f" write zorblax now jane@corp.example with thanks {corpus.prose(rng, 20)}"
        if i % 6 == 1:
            text += f" call 10.1.{i}.7 with thanks"
        rows.append((i, text))
    return rows


def test_base_spans(spark):
    rng = random.Random(1)
    odd = ["".join(rng.choice("0123456789 -.+()@a_") for _ in range(80)) for _ in range(300)]
    docs = corpus.documents(spark, list(enumerate(TEXTS + odd + corpus.texts())) + [(None, TEXTS[0])])
    found = op10.detect(docs).select("doc_id", op10.listed(op10.F.col("spans")).alias("s"))
    want = sorted(((r.doc_id, listed(plain(r.text or ""))) for r in docs.collect()), key=repr)
    assert corpus.bag(found, "doc_id", "s") == want
    assert op10.detect(corpus.empty(spark)).count() == 0


def test_disclosing_terms(spark):
    rows = leaky()
    docs = corpus.documents(spark, rows)
    n_e, n_t, n_te = defaultdict(int), defaultdict(int), defaultdict(set)
    for i, text in rows:
        for t in {w for w in re.findall(r"[^\W\d_]+", text.lower())}:
            n_t[t] += 1
        spans = plain(text)
        for e in {(k, text[a:b].lower()) for a, k, b in spans}:
            n_e[e] += 1
        for a, k, b in spans:
            same = [x for x in spans if x[1] == k]
            low = max([x[2] for x in same if x[2] <= a], default=0)
            high = min([x[0] for x in same if x[0] >= b], default=len(text))
            for part in (text[max(a - 48, low):a], text[b:min(b + 48, high)]):
                for m in WORD.finditer(part):
                    n_te[(k, text[a:b].lower()), m[0].lower()].add(i)
    told = {(e, t) for (e, t), ids in n_te.items() if len(ids) >= 2 and math.log2(
        len(ids) * len(rows) / n_t[t] / n_e[e]) >= 0.8 * math.log2(len(rows) / n_e[e])}
    assert {t for _, t in told} == {"zorblax", "write", "now"}
    got = {(r.doc_id, rows[r.doc_id][1][s.start:s.end])
           for r in op10.detect(docs).collect() for s in r.terms}
    assert got == {(i, w) for i in range(0, 60, 6) for w in ("zorblax", "write", "now")}


def test_terms_of_whole_documents(spark):
    """A term far from the entity, at both ends of a text, with digits, and everywhere."""
    rng, rows = random.Random(9), []
    for i in range(60):
        text = corpus.prose(rng, 60)
        if i % 6 == 0:
            text = f"Zorblax {text} jane@corp.example {text} blaxzor7 {text} zorblax"
        rows.append((i, text))
    rows += [(100, "Quorvex: a@b.co"), (101, "a@b.co quorvex"), (102, "quorvexes a@b.co")]
    docs = corpus.documents(spark, rows)
    texts, got = dict(rows), defaultdict(list)
    for r in op10.detect(docs).collect():
        for s in r.terms:
            got[r.doc_id].append(texts[r.doc_id][s.start:s.end])
    for i in range(0, 60, 6):
        assert sorted(got[i])[:2] == ["Zorblax", "blaxzor7"] and "zorblax" in got[i]
    assert [got[i] for i in (100, 101, 102)] == [["Quorvex"], ["quorvex"], []]
    for r in op10.sanitise(docs).collect():
        assert "zorblax" not in r.text.lower() and "blaxzor7" not in r.text


def test_repeated_rows_count_once(spark):
    rows = leaky()
    want = corpus.bag(op10.detect(corpus.documents(spark, rows)).filter("size(terms) > 0")
                      .selectExpr("doc_id", "transform(terms, t -> round(t.share, 9)) terms"),
                      "doc_id", "terms")
    assert want
    for again in (0, 7):                 # a holder of the entity, and any other document
        docs = corpus.documents(spark, rows + 100 * [rows[again]])
        found = op10.detect(docs)
        assert found.count() == len(rows) + 100
        assert corpus.bag(found.filter("size(terms) > 0").distinct().selectExpr(
            "doc_id", "transform(terms, t -> round(t.share, 9)) terms"), "doc_id", "terms") == want


def test_sanitise(spark):
    rows = leaky() + [(100, None), (101, ""), (None, "a@b.co"), (0, leaky()[0][1])]
    docs = corpus.documents(spark, rows)
    clean = op10.sanitise(docs)
    assert clean.columns == docs.columns and clean.schema["n_chars"].dataType == \
        docs.schema["n_chars"].dataType
    before, after = {}, {}
    for store, table in ((before, docs), (after, clean)):
        for r in table.collect():
            store.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert {k: len(v) for k, v in before.items()} == {k: len(v) for k, v in after.items()}
    for doc, found in after.items():
        for (old, _), (new, n) in zip(before[doc], found):
            assert not plain(new or "") and n == len(new or "")
            assert old == new if not plain(old or "") else "zorblax" not in new
    assert after[None][0][0] == "[email]"


def test_query_columns(spark, tmp_path):
    corpus.documents(spark, list(enumerate(TEXTS[:6]))).write.parquet(f"{tmp_path}/documents.parquet")
    for row in op10.op10_pii(spark, str(tmp_path)).collect():
        spans = plain(TEXTS[row.doc_id])
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(
            sum(s[1] == k for s in spans) for k in range(4))
        assert row.base_sha256 == hashlib.sha256(listed(spans).encode()).hexdigest()


def test_short_names_and_many_entities_of_one_page(spark):
    """A name of two letters counts; a page of many addresses and terms stays small."""
    rng, rows = random.Random(4), []
    page = " ".join(f"name{i} a{i}@corp.example" for i in range(3000))
    for i in range(40):
        text = corpus.prose(rng, 50)
        rows.append((i, f"{text} Bo bo@corp.example {text}" if i % 8 == 0 else text))
    rows += [(100, page), (101, page + " end"), (102, None)]
    docs = corpus.documents(spark, rows)
    texts, got = dict(rows), defaultdict(set)
    for r in op10.detect(docs).collect():
        got[r.doc_id] |= {texts[r.doc_id][s.start:s.end] for s in r.terms}
    assert all("Bo" in got[i] for i in range(0, 40, 8)) and not got[1]
    assert got[100] == got[101] == {f"name{i}" for i in range(3000)}
    clean = {r.doc_id: r.text for r in op10.sanitise(docs).collect()}
    assert clean[100] == " ".join([" [email]"] * 3000) and clean[102] is None
    assert clean[101] == clean[100] + " end"
