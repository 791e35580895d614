"""Eigenvectors and whitened coordinates against exact arithmetic, and the edge cases."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from leadspark.llm import whitening


def exact(rows):
    """(kept rows, distinct integer vectors, n, sums, exact covariance)."""
    kept = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    away = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], dtype=object)
    return kept, fit, n, sums, [[Fraction(int(v), n ** 3) for v in row] for row in away.T @ away]


def check(spark, rows, components=16):
    vectors = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")
    got = whitening.whiten(vectors, components).collect()
    kept, fit, n, sums, cov = exact(rows)
    d = len(sums)
    size = max(float(cov[i][i]) for i in range(d))
    v = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(components, int((values > 1e-12 * size).sum()))
    assert len(got) == k * len(kept) and {r.component for r in got} == set(range(1, k + 1)) and {r.n for r in got} == {n}
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened, r.explained))
    trace = sum(cov[i][i] for i in range(d))
    for i, x in kept:
        assert (i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) in by
    for r in got:
        assert r.explained == pytest.approx(values[r.component - 1] / float(trace), rel=1e-8)
    # Whitened coordinates of the fit list: the axes behind them are eigenvectors of the exact covariance.
    axis = np.zeros((len(fit), k))
    at = {x: a for a, x in enumerate(fit)}
    of = {i: x for i, x in kept}
    for r in got:
        axis[at[of[r.vec_id]], r.component - 1] = r.whitened
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    assert np.allclose(axis.T @ axis / n, np.eye(k), atol=1e-9)
    u = y.T @ axis / n / np.sqrt(values[:k])            # V u / sqrt(e) / sqrt(e)
    assert np.allclose(v @ u, u * values[:k], atol=1e-9 * size)
    return got


def test_contract_on_the_table(spark):
    t = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    check(spark, list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist())))


def test_repeated_rows_and_junk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * [9, 3, 1, 0.5, 0.3]).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(50)] + [rows[1]] * 2
    junk = [(500, None), (501, [None] * 5), (502, [float("nan")] * 5), (503, [float("inf")] * 5)]
    check(spark, rows + junk, 3)
    assert len(check(spark, rows, 16)) == 5 * len(rows)
    other = spark.createDataFrame(rows + [(600, [1.0] * 4), (601, [])], "vec_id long, embedding array<float>")
    assert whitening.whiten(other).filter("vec_id >= 600").count() == 0


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (None, [5.0, 10.0]), (3, [1e12, 2.0])][:3], schema)
    got = whitening.whiten(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 3 and all(r.explained == pytest.approx(1) for r in got)
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)
    assert {r.component for r in whitening.whiten(huge).collect()} <= {1, 2}


@pytest.mark.parametrize("gaps", [[5, 4, 3, 2, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.1], [1, 1 - 1e-12, 1 - 1e-9, 1e-8, 1.00001e-8, 1e-12], [2, 2, 2, 1, 1], [3.0], [0, 0]])
def test_clustered_eigenvalues(gaps):
    rng = np.random.default_rng(len(gaps))
    d = len(gaps)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):      # orthogonal in extended precision
        q = q + q @ (np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    a = (q * np.array(gaps, dtype=np.longdouble)) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigen(a)
    tiny = 1e-17 * max(1, max(gaps))
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    assert np.abs(a @ x - x * values).max() <= tiny
    order = np.argsort(-values)
    for i, g in enumerate(sorted(gaps, reverse=True)):
        assert abs(values[order[i]] - g) <= tiny
        if gaps.count(g) == 1 and min([abs(g - h) for h in gaps if h != g], default=1) >= 1e-12 and g > 1e-9:
            right = q[:, gaps.index(g)]
            assert 1 - abs(right @ x[:, order[i]]) < 1e-9
