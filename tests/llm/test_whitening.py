"""Whitening against a full eigendecomposition in exact integers, repeated eigenvalues, and hard small inputs."""

from fractions import Fraction

import numpy as np
import pytest

from loreweave.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact(x):
    """(values, vectors) of the covariance of integer rows, the sums of products exact; and each row's deviation."""
    n = len(x)
    x = x.astype(object)
    s = x.sum(0)
    y = n * x - s
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in y.T @ y])
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1], (y * y).sum(1), s


def floats(rng, n, width):
    return (rng.standard_normal((n, width)) @ rng.standard_normal((width, width)) * 3).astype(np.float32)


@pytest.mark.parametrize("n,width", [(300, 12), (200, 64), (40, 50)])
def test_equals_a_full_decomposition(spark, n, width):
    c = floats(np.random.default_rng(n), n, width)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(c)], SCHEMA)
    got = whitening.whiten(df).orderBy("id").collect()
    x = np.floor(64 * c.astype(np.float64)).astype(np.int64) + 1_000_000
    values, vectors, deviations, s = exact(x)
    k = min(32, width, n - 1)
    w = np.array([r.whitened for r in got])
    assert w.shape == (n, k)
    y = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s)] for row in x])
    expected = y @ vectors[:, :k] / np.sqrt(values[:k])
    signs = np.sign((w * expected).sum(0))
    assert np.abs(w - signs * expected).max() < 1e-8
    assert [r.deviation for r in got] == list(deviations) and {r.n for r in got} == {n}
    assert np.allclose(got[0].explained, values[:k] / values.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-10


@pytest.mark.parametrize("values", [[5.0] * 40 + [1.0] * 60, [3.0] * 100, list(range(100, 0, -1)), [9.0, 8.0, 7.0] + [0.0] * 97, [4.0] * 20 + [2.0] * 50 + [0.0] * 30])
def test_repeated_eigenvalues_and_breakdowns(values):
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((100, 100)))
    a = q * values @ q.T
    got, vectors = whitening.lanczos(lambda v: a @ v, 100, 32, block=8)
    assert np.allclose(got, sorted(values)[::-1][:32], atol=1e-11 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-11 * max(values)


def test_a_wide_matrix_without_filling_the_space():
    """Residuals end the search long before the basis fills the space."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((1500, 1500)))
    values = 0.8 ** np.arange(1500)
    a, passes = q * values @ q.T, []

    def apply(v):
        passes.append(v.shape[1])
        return a @ v

    got, vectors = whitening.lanczos(apply, 1500, 32)
    assert np.allclose(got, values[:32], rtol=1e-9) and sum(passes) < 500


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [2.0, -1.0]), (3, [0.1, 0.7]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, []), (9, [1.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "'x' as whitened")
    got = whitening.whiten(df).collect()
    assert sorted((r.id or 0) for r in got) == [0, 1, 1, 3] and {r.n for r in got} == {4} and {len(r.whitened) for r in got} == {2}
    for some in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        assert whitening.whiten(spark.createDataFrame(some, SCHEMA)).count() == 0
    far = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [1e12, 5.0])], SCHEMA)
    assert len(whitening.whiten(far).collect()) == 3


def test_query_has_a_row_a_component(spark):
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) == 500 * 32 and got.groupby("vec_id").component.apply(sorted).map(lambda c: c == list(range(1, 33))).all()
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(z.T @ z / 500 - np.eye(32)).max() < 1e-4 and got.identity_error.max() <= 1e-4
