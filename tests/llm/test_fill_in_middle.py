"""Fill-in-middle: exact round trips, plain Python and SQL."""

import hashlib
import random
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import op12_fill_in_middle as op12
from tests.llm import corpus


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
           "restored_sha256")


def rows():
    rng = random.Random(2)
    odd = ["<", "<P", "P>", "S>x<", "a <P> b", "<M>", "<S><S>", "é" * 500 + "<", "漢字 and 𝔘nicode",
           "\0\n\t", "don't stop", "a" * 200_000, " x", "ſK"]
    return (list(enumerate(corpus.texts())) + [(1000 + i, t) for i, t in enumerate(odd)]
            + [(5000 + i, corpus.prose(rng, 20)) for i in range(120)]
            + [(None, None), (None, "a null id"), (7, "same"), (7, "same"), (9, "")])


def test_query_and_its_sql(spark, tmp_path):
    corpus.documents(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12.op12_fill_in_middle(spark, str(tmp_path))
    want = sorted((plain(*r) for r in rows()), key=repr)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert got.columns == list(COLUMNS) and corpus.bag(got, *COLUMNS) == want
    connection = duckdb.connect()
    connection.execute("create view documents as select * from read_parquet("
                       f"'{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(connection.execute(op12.ORACLE_SQL).fetchall(), key=repr) == want
    assert op12.restore(op12.transform(corpus.empty(spark))).count() == 0


def test_outputs_are_texts(spark):
    moved = op12.transform(corpus.documents(spark, rows()), plain_from=100, spm_below=50)
    for row in op12.restore(moved).collect():
        text = bytes(row.restored)
        if row.form != "plain":
            assert bytes(row.output).count(b"<M>") == 1 and len(row.output) == len(text) + 9
            assert row.prefix_chars + row.middle_chars <= len(text.decode())


@settings(max_examples=400, deadline=None)
@given(st.text("ab<>PSM é\n", max_size=40), st.integers(0, 40), st.integers(0, 40),
       st.sampled_from(["psm", "spm", "plain"]))
def test_round_trip(text, a, b, form):
    if re.search("<[PSM]>", text):
        return
    units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text, re.S)] + [len(text)]
    a, b = sorted((units[a % len(units)], units[b % len(units)]))
    parts = [text[:a].encode(), text[a:b].encode(), text[b:].encode()]
    out = op12.rearranged(text.encode(), (len(parts[0]), len(parts[0] + parts[1])), form)
    want = {"plain": b"".join(parts), "psm": b"<P>%s<S>%s<M>%s" % (parts[0], parts[2], parts[1]),
            "spm": b"<S>%s<P>%s<M>%s" % (parts[2], parts[0], parts[1])}
    assert out == want[form] and op12.restored(out, form) == text.encode()
