"""Near vectors against all pairs of a label."""

import math
import random

import duckdb
import numpy as np
import pytest

from folioscope.llm import op13_embedding_near_dedup as op13
from tests.llm import corpus

COLUMNS = ("vec_id", "n_links", "component_id", "kept")
SCHEMA = "vec_id long, embedding array<double>, label int, node long, h1 string, links int"


def plain(rows, least=0.98):
    def usable(r):
        v = r[1]
        return (r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v)
                and any(v))
    vectors = [np.array(r[1], float) if usable(r) else None for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            x, y = a / np.abs(a).max(), b / np.abs(b).max()
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, row in enumerate(rows):
        ids = [r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None]
        component = min(ids, default=None)
        out.append((row[0], links[i], component, row[0] == component))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 5, "x", 1) for i, v, lab in rows], SCHEMA)


def clouds(seed, dims=64, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for centre in rng.standard_normal((n, dims)):
        for _ in range(rng.integers(1, 6)):
            spread = rng.choice([0.05, 0.1, 0.14, 0.2])
            rows.append((centre + spread * rng.standard_normal(dims)).tolist())
    chain = [rng.standard_normal(dims)]
    for _ in range(25):
        chain.append(chain[-1] + 0.15 * rng.standard_normal(dims))
    hot = rng.standard_normal(dims)
    rows += [c.tolist() for c in chain]
    rows += [(hot + 0.1 * rng.standard_normal(dims)).tolist() for _ in range(80)]
    order = rng.permutation(len(rows))
    return [(int(k), rows[i], int(i) % 2 if i < 40 else 1) for k, i in enumerate(order)]


def odd():
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0] * 64, 1), (None, None, 1), (900, None, 1), (901, [], 1),
            (902, [0.0] * 64, 1), (903, [nan] + [1.0] * 63, 1), (904, [inf] + [1.0] * 63, 1),
            (905, [1.0] * 64, None), (906, [None] + [1.0] * 63, 1), (907, [2.0] * 64, 1),
            (908, [1.0] * 63, 1), (908, [1.0] * 63, 1), (909, [-1.0] * 64, 1), (910, [1e300] * 64, 1),
            (911, [1e-300] * 64, 1), (912, [1.0], 1), (913, [3.0], 1), (914, [-3.0], 1),
            (915, [4.0, 3.0], 2), (None, [4.0, 3.1], 2), (2**60 + 1, [1.0, 5.0], 3),
            (2**60 + 1, [1.0, 5.0], 3), (None, [0.0, 1.0], 7), (None, [0.0, 2.0], 7)]


@pytest.mark.parametrize("cell_rows,chunk", [(16384, 4096), (40, 4096), (8, 7)])
def test_all_links_and_components(spark, cell_rows, chunk):
    rows = clouds(3) + odd()
    got = op13.near_vectors(table(spark, rows), cell_rows=cell_rows, chunk=chunk)
    assert got.columns == list(COLUMNS)
    assert corpus.bag(got, *COLUMNS) == plain(rows)


@pytest.mark.parametrize("dims", [1, 3, 20, 100])
def test_other_lengths(spark, dims):
    rows = clouds(dims, dims, 12)
    got = op13.near_vectors(table(spark, rows), cell_rows=30, chunk=20)
    assert corpus.bag(got, *COLUMNS) == plain(rows)


def test_one_vector_a_third_of_all(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], 0) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)]
    got = op13.near_vectors(table(spark, rows))
    assert corpus.bag(got, *COLUMNS) == plain(rows)
    assert op13.near_vectors(table(spark, [])).count() == 0


def test_query_and_its_sql(spark, tmp_path):
    rows = [r for r in clouds(8) if r[0] is not None] + [(5000, None, 1), (5001, [1.0] * 64, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13.op13_embedding_near_dedup(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute("create view embeddings as select * from read_parquet("
                       f"'{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(connection.execute(op13.ORACLE_SQL).fetchall(), key=repr)
    assert corpus.bag(got, *COLUMNS) == want == plain(rows)
