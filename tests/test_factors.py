"""Embedding, non-negative factors and the blocked inverse against numpy."""

import zlib

import numpy as np
import pytest
from lineupkit.operators import factors
from pyspark.sql import functions as F


def frame(spark, m, names, least=None):
    rows = [(names[a], names[b], float(m[a, b])) for a in range(len(m)) for b in range(a + 1, len(m)) if least is None or m[a, b] > least]
    return spark.createDataFrame(rows, "i string, j string, x double")


def symmetric(n, seed, rank=6):
    rng = np.random.default_rng(seed)
    w = rng.random((n, rank)) ** 2
    m = w @ np.diag(np.linspace(3, 1, rank)) @ w.T + 0.05 * rng.random((n, n))
    m = (m + m.T) / 2
    np.fill_diagonal(m, 0)
    return m, [f"f{k:03d}" for k in range(n)]


def test_singular_values_and_vectors(spark):
    m, names = symmetric(40, 1)
    rows, sigma = factors.spectral_embedding(frame(spark, m, names), 5, oversample=8, tol=1e-13)
    want = np.linalg.svd(m)[1][:5]
    assert sigma == pytest.approx(want, rel=1e-6)
    got = {r.feature: (r.u, r.embedding) for r in rows.collect()}
    u = np.array([got[n][0] for n in names])
    assert np.abs(u.T @ u - np.eye(5)).max() < 1e-8
    assert np.abs(m @ (m @ u) - u * want**2).max() < 1e-4 * want[0] ** 2
    assert (u[np.abs(u).argmax(0), range(5)] > 0).all()
    e = u * np.sqrt(want)
    e /= np.sqrt((e * e).sum(1))[:, None]
    assert np.abs(np.array([got[n][1] for n in names]) - e).max() < 1e-6


def test_similarity_residual_and_substitutes(spark):
    m, names = symmetric(12, 2)
    pairs = frame(spark, m, names)
    rows, _ = factors.spectral_embedding(pairs, 3, oversample=4)
    e = np.array([r.embedding for r in rows.orderBy("feature").collect()])
    residual = factors.role_residuals(factors.similarities(rows), pairs, 0.5)
    got = {(r.i, r.j): r.score for r in residual.collect()}
    score = e @ e.T - 0.5 * m / m.max()
    assert len(got) == 66 and all(got[names[a], names[b]] == pytest.approx(score[a, b]) for a in range(12) for b in range(a + 1, 12))
    np.fill_diagonal(score, -9)
    best = {r.feature: (r.substitute, r.score) for r in factors.closest_substitutes(residual).collect()}
    assert all(best[names[a]] == (names[score[a].argmax()], pytest.approx(score[a].max())) for a in range(12))


def test_embedding_of_few_rows(spark):
    one = spark.createDataFrame([("a", "b", 2.0)], "i string, j string, x double")
    rows, sigma = factors.spectral_embedding(one, 5)
    assert sigma == pytest.approx([2.0, 2.0]) and rows.count() == 2
    rows, sigma = factors.spectral_embedding(one.limit(0), 5)
    assert rows.count() == 0 and sigma == []


def test_factors_equal_the_plain_updates(spark):
    m, names = symmetric(20, 3)
    long, history = factors.nonnegative_factors(frame(spark, m, names), [2, 4], rounds=6)
    start = lambda k, at, salt: np.array([[0.01 + 0.99 * (zlib.crc32(f"{salt}|{c}|{n}".encode()) + 1) / 4294967297 for c in range(at, at + k)] for n in names])
    for k, at in ((2, 0), (4, 2)):
        scale = 2 * (m.sum() / 400 / k) ** 0.5
        w, h = start(k, at, "w") * scale, start(k, at, "h") * scale
        errors = []
        for _ in range(6):
            h = h * (m @ w) / (h @ (w.T @ w))
            w = w * (m @ h) / (w @ (h.T @ h))
            errors.append(np.linalg.norm(m - w @ h.T) / np.linalg.norm(m))
        mine = [x for x in history if x["k"] == k]
        assert [x["error"] for x in mine] == pytest.approx(errors, abs=1e-9)
        assert all(b <= a + 1e-12 for a, b in zip(errors, errors[1:], strict=False))
        got = {(r.feature, r.component): (r.w, r.h) for r in long.where(F.col("k") == k).collect()}
        assert len(got) == 20 * k
        assert all(got[names[a], c + 1] == pytest.approx((w[a, c], h[a, c])) for a in range(20) for c in range(k))
        assert mine[0]["correlation"] == pytest.approx(np.corrcoef(w.ravel(), h.ravel())[0, 1])
    assert factors.nonnegative_factors(frame(spark, m, names).limit(0), [2])[1] == []


def test_inverse_of_150_features(spark):
    rng = np.random.default_rng(4)
    c = np.corrcoef((rng.random((2000, 150)) < rng.random(150) * 0.5 + 0.02).T.astype(float))
    names = [f"f{k:03d}" for k in range(150)]
    found, far = factors.inverse(frame(spark, c, names), 1.05)
    want = np.linalg.inv(c + 0.05 * np.eye(150))
    got = {(r.i, r.j): r.x for r in found.collect()}
    assert far < 1e-8 and len(got) == 150 * 151 // 2
    x = np.array([[got[min(a, b), max(a, b)] for b in names] for a in names])
    assert np.abs(x - want).max() < 1e-8 and np.abs((c + 0.05 * np.eye(150)) @ x - np.eye(150)).max() < 1e-8


def test_inverse_without_rows_and_singular(spark):
    none = spark.createDataFrame([], "i string, j string, x double")
    assert factors.inverse(none, 1.0)[0].count() == 0
    with pytest.raises(ValueError):
        factors.inverse(spark.createDataFrame([("a", "b", 1.0)], none.schema), 1.0, size=2, rounds=8)
    with pytest.raises(ValueError):
        factors.gaussian_couplings(none.withColumnRenamed("x", "corr"), 0.0)
