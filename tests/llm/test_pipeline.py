"""The pipeline: each stage against brute force on what it is given."""

import pytest

import corpus_pipeline
from tests.llm import corpus
from tests.llm.test_decontamination import benchmark, expected
from tests.llm.test_near_copies import plain_roots
from tests.llm.test_pii import plain
from tests.llm.test_quality import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = labelled(spark, 200)
    shift = 1000
    more = corpus.documents(spark).selectExpr(
        f"doc_id + {shift} doc_id", "concat(text, ' me@corp.example 10.0.0.7') text", "lang",
        "source", "n_chars", "score", "spans", "hits")
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    benchmark(spark)[0].write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        steps[name] = docs, spark.read.parquet(f"{tmp_path}/{k}")
        docs = steps[name][1]
    for name, (_, after) in steps.items():
        assert name == "packing" or after.columns == columns
    rows = {n: tuple([(r.doc_id, r.text) for r in t.collect()] for t in pair)
            for n, pair in steps.items() if n != "packing"}
    before, after = rows["quality"]
    assert 0.5 * len(before) < len(after) < len(before)
    assert sum("### ### " in (t or "") for _, t in after) == 0
    before, after = rows["near_dedup"]
    assert len(after) == len(set(plain_roots([t for _, t in before]))) < len(before)
    before, after = rows["decontamination"]
    items = benchmark(spark)[1]
    assert any(r[-1] for r in expected(before, items))
    assert not any(r[-1] for r in expected(after, items))
    before, after = rows["pii"]
    assert any(plain(t or "") for _, t in before) and not any(plain(t or "") for _, t in after)
    assert len(before) == len(after)
    packed = steps["packing"][1]
    assert packed.select("doc_id").distinct().count() == len({i for i, _ in after})


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns[:3] == ["doc_id", "piece", "start"]
