"""Block products, Cholesky and redundancy against numpy's solver."""

import numpy as np
import pytest

from strandloom.operators import block_matrix as M


def brute(x, y, folds, penalty):
    """Out-of-fold predictions with the training mean for missing targets."""
    out = np.zeros_like(y)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    reg = penalty * np.eye(x1.shape[1])
    reg[-1, -1] = 0
    for f in np.unique(folds):
        train = folds != f
        t = y[train]
        known = np.isfinite(t)
        mean = np.where(known, t, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        t = np.where(known, t, mean)
        out[~train] = x1[~train] @ np.linalg.solve(x1[train].T @ x1[train] + reg, x1[train].T @ t)
    return out


@pytest.mark.parametrize("width", [128, 5, 4])
def test_redundancy_equals_numpy(spark, width):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 11)) + 3
    y = np.column_stack([x[:, 0] * 2 - x[:, 3] + 0.1 * rng.normal(size=300), rng.normal(size=300), np.full(300, 7.0), x[:, 5] ** 2])
    y[rng.random(y.shape) < 0.2] = np.nan
    folds = rng.integers(0, 4, 300)
    rows = [(int(f), a.tolist(), [None if np.isnan(v) else float(v) for v in b]) for f, a, b in zip(folds, x, y)]
    df = spark.createDataFrame(rows, "fold int, features array<double>, targets array<double>").repartition(3)
    got = {r.target: r for r in M.redundancy(df, penalty=2.0, least=100, width=width).collect()}
    p = brute(x, y, folds, 2.0)
    for j in range(4):
        ok = np.isfinite(y[:, j])
        assert got[j].n == ok.sum()
        if j == 2:
            assert got[j].r2 is None
        else:
            assert got[j].r2 == pytest.approx(1 - ((y[ok, j] - p[ok, j]) ** 2).sum() / ((y[ok, j] - y[ok, j].mean()) ** 2).sum())
    assert M.redundancy(df, least=1000).where("r2 IS NOT NULL").count() == 0


def test_targets_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, y, folds = rng.normal(size=(120, 3)), rng.normal(size=(120, 5)), np.arange(120) % 3
    df = spark.createDataFrame([(int(f), a.tolist(), b.tolist()) for f, a, b in zip(folds, x, y)], "fold int, features array<double>, targets array<double>")
    whole = sorted(map(tuple, M.redundancy(df, least=10).collect()))
    monkeypatch.setattr(M, "SENT_BYTES", 8 * 4 * 3 * 2)
    assert M.target_groups(3, 5, 3) == [(0, 2), (2, 4), (4, 5)]
    assert [r[0] for r in whole] == list(range(5)) and [r[2] for r in sorted(map(tuple, M.redundancy(df, least=10).collect()))] == pytest.approx([r[2] for r in whole])


def test_predictions_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, folds = rng.normal(size=(200, 9)), rng.integers(0, 3, 200)
    y = x @ rng.normal(size=9) + rng.normal(size=200)
    df = spark.createDataFrame([(i, int(folds[i]), float(y[i]), x[i].tolist()) for i in range(200)], "key long, fold int, label double, features array<double>")
    got = {r.key: r.prediction for r in M.ridge_predictions(df, 1.5, width=4).collect()}
    assert [got[i] for i in range(200)] == pytest.approx(brute(x, y[:, None], folds, 1.5)[:, 0].tolist())


def test_many_columns_and_targets(spark):
    rng = np.random.default_rng(4)
    x, folds = rng.normal(size=(1500, 300)), np.arange(1500) % 2
    y = x[:, :20] @ rng.normal(size=(20, 50)) + rng.normal(size=(1500, 50))
    df = spark.createDataFrame([(int(f), a.tolist(), b.tolist()) for f, a, b in zip(folds, x, y)], "fold int, features array<double>, targets array<double>").repartition(4)
    got = {r.target: r.r2 for r in M.redundancy(df, penalty=10.0).collect()}
    p = brute(x, y, folds, 10.0)
    assert [got[j] for j in range(50)] == pytest.approx([1 - ((y[:, j] - p[:, j]) ** 2).sum() / ((y[:, j] - y[:, j].mean()) ** 2).sum() for j in range(50)])
