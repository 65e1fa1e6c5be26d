import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, deviation string, c string"


def rows_of(vectors, first=0):
    return [(first + i, None if v is None else [None if e is None else float(e) for e in v], 7, "d", "c") for i, v in enumerate(vectors)]


def brute(vectors, components):
    """numpy's eigendecomposition of the covariance of the integer vectors, exact deviations in Python integers."""
    x = np.array([[math.floor(1024 * float(np.float32(e))) + 100_000 for e in v] for v in vectors])
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    e, u = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1], u[:, ::-1]
    white = (x - x.mean(axis=0)) @ u[:, :components] / np.sqrt(e[:components])
    return white, [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x], e / e.sum()


@pytest.mark.parametrize("n,d,components", [(300, 20, 8), (50, 3, 8), (9, 1, 8), (200, 130, 4)])
def test_against_numpy(spark, n, d, components):
    rng = np.random.default_rng(d)
    vectors = rng.normal(size=(n, d)) * np.linspace(1, 3, d) + rng.normal(size=d)
    rows = rows_of(vectors)
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), components=components).collect()
    white, deviation, share = brute(vectors, min(components, d))
    assert got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = np.full(white.shape, np.nan)
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    assert len(got) == found.size and not np.isnan(found).any()
    assert np.abs(found * np.sign((found * white).sum(axis=0)) - white).max() < 1e-7


def test_odd_rows(spark):
    """Unusable rows go, the rest is as without them; repeated rows, null ids and other columns do no harm."""
    rng = np.random.default_rng(3)
    good = rows_of(rng.normal(size=(60, 5)))
    good += [good[0], (None, *good[1][1:])]
    bad = rows_of([None, [], [1, 2, 3, 4, None], [1, 2, float("nan"), 4, 5], [float("inf"), 0, 0, 0, 0], [0, -float("inf"), 0, 0, 0], [1e30, 0, 0, 0, 0], [1, 2, 3]], 900)
    clean = whitening.whiten(spark.createDataFrame(good, SCHEMA))
    mixed = whitening.whiten(spark.createDataFrame(good + bad, SCHEMA))
    key = lambda r: (r.vec_id is not None, r.vec_id or 0, r.component, r.whitened)
    a, b = sorted(clean.collect(), key=key), sorted(mixed.collect(), key=key)
    assert len(a) == 62 * 5 and [r[:4] for r in a] == [r[:4] for r in b]
    assert np.allclose([abs(r.whitened) for r in a], [abs(r.whitened) for r in b])
    assert sum(r.vec_id == 0 for r in a) == 10 and sum(r.vec_id is None for r in a) == 5


def test_no_variance(spark):
    for rows in ([], rows_of([[1, 2]]), rows_of([[1, 2]] * 4), rows_of([None, None])):
        got = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert got.collect() == [] and got.columns[:2] == ["vec_id", "component"]


def test_fewer_directions_than_dimensions(spark):
    """Two directions among five dimensions give two components, not noise."""
    got = whitening.whiten(spark.createDataFrame(rows_of([[i, 2 * i, j, 0, 1] for i in range(6) for j in range(4)]), SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-9


def test_deviation_beyond_64_bits_is_null(spark):
    huge = [2.0**39, -(2.0**39), 1.0]
    got = whitening.whiten(spark.createDataFrame(rows_of([[h, 1] for h in huge] * 1000), SCHEMA)).where(F.col("component") == 1).collect()
    assert len(got) == 3000 and all(r.deviation is None for r in got if r.vec_id % 3 < 2) and got[0].identity_error < 1e-6
