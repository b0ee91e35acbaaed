"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def dense(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors])
    n, total = len(x), x.sum(axis=0)
    c = (x * n - total) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, total)) for row in x]
    return c, values[::-1], axes[:, ::-1], deviation


def same(rows, vectors, ids, components=32):
    c, values, axes, deviation = dense(vectors)
    k = min(components, c.shape[1])
    want = c @ (axes[:, :k] / np.sqrt(values[:k]))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids) and all(sorted(v) == list(range(1, k + 1)) for v in got.values())
    mine = np.array([[got[i][j + 1].whitened for j in range(k)] for i in ids])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * signs - want).max() < 1e-8
    for i, d in zip(ids, deviation):
        assert got[i][1].deviation == d and got[i][1].n == len(ids)
        assert got[i][1].identity_error < 1e-9
        for j in range(k):
            assert got[i][j + 1].explained == pytest.approx(values[j] / values.sum(), rel=1e-10)


def test_query(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    found = queries.op11_whitening(spark, small_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(found.collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_filter_finds_a_steep_and_a_flat_spectrum(spark):
    rng = np.random.default_rng(3)
    for spread in (np.linspace(1, 1.05, 60), 0.9 ** np.arange(60)):
        x = rng.standard_normal((400, 60)) * spread * 4
        df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], SCHEMA).repartition(3)
        model = whitening.fit(df, components=10, guard=8)
        assert model.passes > 1  # the block does not hold all dimensions
        same(whitening.whitened_rows(df, 10).collect(), x, list(range(400)), 10)
        c, values, axes, _ = dense(x)
        assert np.allclose(model.values, values[:10], rtol=1e-12)
        assert np.allclose(np.abs((model.axes * axes[:, :10]).sum(axis=0)), 1, atol=1e-11)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [[float(c) for c in v] for v in rng.standard_normal((50, 5))]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(50, good[0], 1), (None, good[1], None)]
    bad = [(60, None, 1), (61, [], 1), (62, [1.0, None, 1.0, 1.0, 1.0], 1), (63, [1.0, float("nan"), 1.0, 1.0, 1.0], 1),
           (64, [float("inf")] * 5, 1), (None, None, None)]
    found = whitening.whitened_rows(spark.createDataFrame(rows + bad, SCHEMA)).collect()
    assert len(found) == 52 * 5
    named = [r for r in found if r.vec_id is not None]
    assert {r.vec_id for r in named} == set(range(51))
    c, values, axes, deviation = dense(good + [good[0], good[1]])
    assert {r.deviation for r in found if r.vec_id is None} == {deviation[1]}
    assert {r.vec_id: r.deviation for r in named} == {i: deviation[i] for i in range(51)}


def test_no_variance_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    assert whitening.whitened_rows(one).count() == 0
    assert whitening.whitened_rows(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)], SCHEMA)
    rows = whitening.whitened_rows(line).collect()
    assert len(rows) == 9 and {r.component for r in rows} == {1} and rows[0].explained == pytest.approx(1)
    with pytest.raises(Exception, match="one length"):
        whitening.whitened_rows(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA).coalesce(1))


def test_clashing_names_and_large_counts(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(c) for c in v], 3) for i, v in enumerate(rng.standard_normal((40, 4)))], SCHEMA)
    df = df.withColumn("_whitened", F.lit("mine")).withColumn("_deviation", F.lit(1)).withColumn("at", F.lit(2)).withColumn("v", F.lit(2))
    out = whitening.transform(df, whitening.fit(df, components=2))
    assert out.columns == [*df.columns, "_whitened_", "_deviation_"]
    assert {r["_whitened"] for r in out.collect()} == {"mine"} and all(len(r["_whitened_"]) == 2 for r in out.collect())
    x = np.array([[10 ** 6, 3], [5, 10 ** 6]])
    n, total = 10 ** 4, np.array([10 ** 10, 10 ** 10 + 7])
    assert whitening._deviations(x, n, total).tolist() == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, total)) for r in x]
