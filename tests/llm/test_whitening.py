"""Whitening against NumPy's eigensolver and plain whole-number sums."""

import numpy as np
import pytest

from clipgraph_spark.llm import whitening as w


def frame(spark, vectors, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], schema)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 150])
def test_solver_equals_numpy(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    v = a @ a.T / n
    values, x = w.leading_components(v, 32)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][: len(values)], rtol=0, atol=1e-13 * values[0])
    assert np.abs(v @ x.T - x.T * values).max() < 1e-13 * values[0]
    assert np.abs(x @ x.T - np.eye(len(x))).max() < 1e-12


def test_clusters_and_zero_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))
    v = (q * ([5.0] * 9 + [5.0 - 1e-9] * 3 + [1.0] * 8 + [0.0] * 20)) @ q.T
    values, x = w.leading_components((v + v.T) / 2, 32)
    assert len(values) in range(20, 33) and np.allclose(values[:20], [5.0] * 9 + [5.0 - 1e-9] * 3 + [1.0] * 8)
    assert np.abs(x[:20] @ x[:20].T - np.eye(20)).max() < 1e-12 and np.abs(v @ x[:20].T - x[:20].T * values[:20]).max() < 1e-13 * 5
    assert len(w.leading_components(np.ones((30, 30)), 32)[0]) == 1
    assert len(w.leading_components(np.zeros((3, 3)), 32)[0]) == 0
    values, x = w.leading_components(np.diag(np.arange(1.0, 41.0)), 3)
    assert values.tolist() == [40, 39, 38] and np.abs(x).max(1).tolist() == [1, 1, 1]


def test_sturm_count_equals_numpy():
    rng = np.random.default_rng(2)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[10] = 0
    all_ = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 50)
    assert w.sturm_count(d, e, x).tolist() == [(all_ < t).sum() for t in x]


def test_rows_equal_plain_sums(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((400, 12)) * np.arange(1, 13)).astype(np.float32)
    vectors[100:250] = vectors[0]  # a third and more are one vector
    out = w.whiten(frame(spark, vectors.tolist()).repartition(7), k=5).toPandas()
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = y.T @ y / n
    values, vec = np.linalg.eigh(v)
    ref = y @ vec[:, ::-1][:, :5] / np.sqrt(values[::-1][:5])
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == (400, 5) and np.abs(np.abs((ref * got).sum(0)) - 400).max() < 1e-8
    assert np.abs(ref * np.sign((ref * got).sum(0)) - got).max() < 1e-9
    first = out[out.component == 1].sort_values("vec_id")
    assert first.deviation.tolist() == [sum(int(a) ** 2 for a in row) for row in n * x - s]
    assert np.allclose(out.groupby("component").explained.first(), values[::-1][:5] / np.trace(v), rtol=1e-9)
    assert (out.n == 400).all() and out.identity_error.max() < 1e-10


def test_odd_vectors(spark):
    good = np.random.default_rng(4).standard_normal((20, 3)).round(3).tolist()
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [1.0, float("inf"), 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [3e38, 0.0, 0.0]]
    plain = w.whiten(frame(spark, good)).toPandas().sort_values(["vec_id", "component"], ignore_index=True)
    mixed = w.whiten(frame(spark, good + odd)).toPandas().sort_values(["vec_id", "component"], ignore_index=True)
    assert mixed.drop(columns="whitened").round(9).equals(plain.drop(columns="whitened").round(9)) and np.allclose(mixed.whitened, plain.whitened)
    for rows in ([], odd[:5], [[1.0, 2.0]] * 4, [[5.0, 6.0, 7.0]]):
        assert w.whiten(frame(spark, rows)).count() == 0
    twice = w.whiten(spark.createDataFrame([(None, [0.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] is None, r["n"], r["deviation"]) for r in twice) == [(False, 3, 64**2), (False, 3, 64**2), (True, 3, 128**2)]


def test_wide_numbers_and_names(spark):
    big = [[float(2**50), 1.0], [float(-(2**50)), 2.0], [0.0, 3.0]]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in enumerate(big)], "vec_id long, v array<double>, k string, Whitened string")
    out = w.project(df, w.fit(df, "v"), ("vec_id", "k", "Whitened"), "v").collect()
    assert sorted(out[0].asDict()) == ["Whitened", "deviation", "k", "vec_id", "whitened_"]
    assert {r["deviation"] for r in out if r["vec_id"] < 2} == {None} and len(out) == 3
    assert w.whiten(df, ("vec_id", "k"), "v").count() == 3  # the second direction is zero to working precision
    with pytest.raises(ValueError):
        w.fit(frame(spark, [[0.0] * (w.MAX_DIMS + 1)]))
