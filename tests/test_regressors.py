"""Partial least squares, nearest neighbours and kernel features against numpy."""

import numpy as np
import pytest

from strandloom.operators import models as M, regressors as R


def sample(spark, n=240, p=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * rng.uniform(0.5, 4, p) + 2
    y = np.sin(x[:, 0]) * 3 + x[:, 1] + 0.1 * rng.normal(size=n)
    folds = rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, int(folds[i]), float(y[i]), x[i].tolist()) for i in range(n)], "key long, fold int, label double, features array<double>").repartition(3)
    return x, y, folds, df


def scaled(x, folds, f):
    t = x[folds != f]
    return (x - t.mean(axis=0)) / t.std(axis=0)


@pytest.mark.parametrize("components", [1, 3, 6, 25])
def test_pls_equals_deflation(spark, components):
    x, y, folds, df = sample(spark)
    got = {r.key: r.prediction for r in R.pls_predictions(df, components).collect()}
    for f in range(3):
        z, train = scaled(x, folds, f), folds != f
        a, v = z[train].copy(), y[train] - y[train].mean()
        ws, ps, qs = [], [], []
        for _ in range(min(components, 6)):
            w = a.T @ v
            w /= np.linalg.norm(w)
            t = a @ w
            p, q = a.T @ t / (t @ t), v @ t / (t @ t)
            a, v = a - np.outer(t, p), v - q * t
            ws, ps, qs = [*ws, w], [*ps, p], [*qs, q]
        W, P = np.array(ws).T, np.array(ps).T
        want = y[train].mean() + z[~train] @ W @ np.linalg.solve(P.T @ W, np.array(qs))
        assert [got[i] for i in np.flatnonzero(~train)] == pytest.approx(want.tolist(), abs=1e-6)


@pytest.mark.parametrize("tile", [30, 2048])
def test_knn_equals_all_pairs(spark, tile):
    x, y, folds, df = sample(spark, 150)
    df = df.unionByName(df.where("key = 7").selectExpr("1000L as key", "(fold + 1) % 3 as fold", "label + 5 as label", "features"))
    x, y, folds = np.vstack([x, x[7]]), np.append(y, y[7] + 5), np.append(folds, (folds[7] + 1) % 3)
    got = {r.key: r.prediction for r in R.knn_predictions(df, 5, tile).collect()}
    for i in range(151):
        z = scaled(x, folds, folds[i])
        others = np.flatnonzero(folds != folds[i])
        d = np.sqrt(((z[others] - z[i]) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:5]
        d, v = d[near], y[others[near]]
        want = v[d == 0].mean() if (d == 0).any() else (v / d).sum() / (1 / d).sum()
        assert got[i if i < 150 else 1000] == pytest.approx(want)


def test_kernel_features_tend_to_the_kernel(spark):
    x, y, folds, df = sample(spark, 60, 3)
    scale = {"mean": np.zeros(3), "sd": np.ones(3)}
    made = {r.key: np.array(r.features) for r in R.kernel_features(df, 3, 6000, 0.1, scale, 1).collect()}
    for i in range(0, 60, 7):
        for j in range(0, 60, 5):
            assert made[i] @ made[j] == pytest.approx(np.exp(-0.1 * ((x[i] - x[j]) ** 2).sum()), abs=0.06)
    x, y, folds, df = sample(spark, 400, 3)
    error = np.array([r.prediction - r.label for r in R.kernel_predictions(df, 300, penalty=0.5).collect()])
    assert (error**2).mean() < 0.8 * y.var()


def test_zoo_on_one_set_of_folds(spark):
    _, _, _, df = sample(spark, 90)
    settings = {"pls": {"components": 2}, "knn": {"k": 3}, "kernel": {"features": 20}, "hist": {"trees": 2}, "block_ridge": {}}
    found = M.compare_models(df, [*settings, "tree"], range(3), settings=settings).collect()
    assert sorted((r.model, r.fold) for r in found) == sorted((m, f) for m in [*settings, "tree"] for f in range(3)) and all(r.n > 0 for r in found)
