import random
from decimal import Decimal

import numpy as np
import pytest

from netfusion.llm.whitening import Centring, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n string, w int"


def brute(vectors, most=32):
    """By the covariance itself: (integers, n, sums, eigenvalues, eigenvectors as columns)."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors])
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return x, n, s, e[::-1][:most], v[:, ::-1][:, :most], e.sum()


def table(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) @ rng.normal(size=(d, d))).astype(np.float32)


@pytest.mark.parametrize("n, d, parts", [(400, 40, 1), (3000, 8, 37), (60, 5, 60)])
def test_as_by_covariance(spark, n, d, parts):
    data = table(n, d, n)
    rows = [(i, v.tolist(), "x", "y", 1) for i, v in enumerate(data)]
    rows += [(900_001, None, "", "", 0), (900_002, [None] + [0.5] * (d - 1), "", "", 0), (900_003, [float("nan")] * d, "", "", 0), (900_004, [float("-inf")] + [0.0] * (d - 1), "", "", 0)]
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    x, n, s, e, v, trace = brute(data)
    k = min(32, d)
    assert len(got) == n * k and {r.n for r in got} == {n}
    want = ((n * x - s) / n) @ v / np.sqrt(e)
    whitened = np.zeros((n, k))
    for r in got:
        whitened[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert r.deviation == sum(int(n * a - b) ** 2 for a, b in zip(x[r.vec_id].tolist(), s.tolist(), strict=True))
    signs = np.sign((whitened * want).sum(0))
    assert np.allclose(whitened * signs, want, atol=1e-6)
    assert np.abs(whitened.T @ whitened / n - np.eye(k)).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-8


def test_odd_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, "", "", 0), (2, [], "", "", 0)], SCHEMA)).collect() == []
    one = whiten(spark.createDataFrame([(None, [0.5, 0.25], "", "", 0)], SCHEMA)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, None, 0.0, None), (None, 2, 1, 0, None, 0.0, None)]
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [0.5], "", "", 0), (2, [0.5, 1.0], "", "", 0)], SCHEMA))


def test_repeated_rows_and_constant_dimension(spark):
    rows = [(1, [0.5, 1.0], "", "", 0), (1, [0.5, 1.0], "", "", 0), (2, [0.5, -1.0], "", "", 0)]
    got = sorted(whiten(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.component, r.vec_id))
    assert [r.vec_id for r in got] == [1, 1, 2] * 2
    assert [r.explained for r in got] == [1.0] * 3 + [0.0] * 3
    a, b, c = (r.whitened for r in got[:3])
    assert a == b and a == pytest.approx(-c / 2) and abs(a) == pytest.approx(0.5**0.5)
    assert [r.whitened for r in got[3:]] == [None] * 3
    assert got[0].identity_error < 1e-12


def test_skewed_scales_keep_double_precision(spark):
    """Directions that differ by nine orders of magnitude, which a covariance would lose."""
    rng = random.Random(3)
    x = [[rng.randrange(-(2**30), 2**30), rng.randrange(-2, 3)] for _ in range(2000)]
    rows = [(i, [a / 64, b / 64]) for i, (a, b) in enumerate(x)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)).collect()
    w = np.zeros((2000, 2))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(w.T @ w / 2000 - np.eye(2)).max() < 1e-6 and got[0].identity_error < 1e-6


def test_exact_beyond_longs():
    n, x = 10**9, np.array([[2**45, 1]])
    s = np.array([n * 2**44, 0], object)
    c = Centring(n, s, np.array([0, 0]), np.array([2**45, 1]))
    assert not c.small
    assert c.deviations(x) == [Decimal((n * 2**44) ** 2 + n**2)] or (n * 2**44) ** 2 + n**2 >= 10**38
