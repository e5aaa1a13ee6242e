"""Histogram boosting and path attribution against plain numpy."""

import itertools
import math

import numpy as np
import pytest

from strandloom.operators import boosting as B


def rows_of(spark, x, y, folds=3):
    data = [(i, i % folds, float(y[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(data, "key long, fold int, label double, features array<double>").repartition(3)


def sample(n=400, p=6, seed=1, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 2] = np.round(x[:, 2])
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0.3, 3.0, -1.0) + 0.1 * rng.normal(size=n)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def brute_best(x, g, rows, l2, least):
    """Best cut of one node over all columns and distinct values: (gain, column, greatest value to the left, missing left)."""
    best = (-np.inf, None, None, None)
    for j in range(x.shape[1]):
        v = x[rows, j]
        known = np.unique(v[~np.isnan(v)])
        for left_missing in (False, True):
            for c in known[:-1]:
                left = (v <= c) | (np.isnan(v) & left_missing)
                a, b = g[rows][left], g[rows][~left]
                if len(a) < least or len(b) < least:
                    continue
                gain = 0.5 * (a.sum() ** 2 / (len(a) + l2) + b.sum() ** 2 / (len(b) + l2) - g[rows].sum() ** 2 / (len(rows) + l2))
                if gain > best[0] + 1e-9:
                    best = (gain, j, c, left_missing)
    return best


def test_first_levels_equal_brute_force(spark):
    x, y = sample(150)
    model = B.fit_boosted(rows_of(spark, x, y), trees=2, depth=2, bins=254, row_share=1.0, column_share=1.0, least=3)
    m = model.members[0]
    assert m.base == pytest.approx(y.mean())
    margin = np.full(len(y), y.mean())
    for t in range(2):
        g = margin - y
        groups = {0: np.arange(len(y))}
        for level in range(2):
            for node in [k for k in groups if (1 << level) - 1 <= k < (2 << level) - 1]:
                rows = groups[node]
                gain, j, c, left_missing = brute_best(x, g, rows, 1.0, 3)
                assert m.trees.column[t, node] == j and m.trees.gain[t, node] == pytest.approx(gain)
                assert m.trees.threshold[t, node] >= c and not ((x[rows, j] > c) & (x[rows, j] <= m.trees.threshold[t, node])).any()
                assert m.trees.cover[t, node] == len(rows)
                left = (x[rows, j] <= c) | (np.isnan(x[rows, j]) & left_missing)
                groups[2 * node + 1], groups[2 * node + 2] = rows[left], rows[~left]
        for node in range(3, 7):
            rows = groups[node]
            assert m.trees.value[t, node] == pytest.approx(-0.05 * g[rows].sum() / (len(rows) + 1))
        for node in range(3, 7):
            margin[groups[node]] += m.trees.value[t, node]
    got = {r.key: r.prediction for r in B.boosted_predictions(rows_of(spark, x, y), model).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(margin.tolist())


def test_members_refreshed_predictions_and_held_out_quality(spark):
    x, y = sample(600, 5, 2)
    df = rows_of(spark, x, y)
    one = B.fit_boosted(df, [0, 1, 2], [0, 5], trees=12, depth=3, rate=0.4, refresh=5)
    two = B.fit_boosted(df, [0, 1, 2], [0, 5], trees=12, depth=3, rate=0.4, refresh=100)
    a, b = ({(r.key, r.seed): r.prediction for r in B.boosted_predictions(df, m).collect()} for m in (one, two))
    assert len(a) == 1200 and a == pytest.approx(b)
    error = np.array([a[i, s] - y[i] for i in range(600) for s in (0, 5)])
    assert 1 - (error**2).mean() / y.var() > 0.8
    assert any(a[i, 0] != a[i, 5] for i in range(600))
    gains = one.gains()
    assert gains.sum() == pytest.approx(1) and set(np.argsort(-gains)[:2]) == {0, 1}
    chosen = B.top_columns(one, 2)
    assert all(set(c) == {0, 1} for c in chosen.values())
    narrow = B.fit_boosted(df, [0], [0], trees=3, columns={(0, 0): [0, 1]})
    assert set(np.unique(narrow.members[0].trees.column)) <= {-1, 0, 1}


@pytest.mark.parametrize("settings", [{"objective": "huber", "delta": 1.0}, {"drop": 0.3}])
def test_other_objectives_learn(spark, settings):
    x, y = sample(300, 4, 3)
    y[:5] += 200 * ("objective" in settings)
    df = rows_of(spark, x, y)
    got = {r.key: r.prediction for r in B.boosted_predictions(df, B.fit_boosted(df, trees=25, depth=3, rate=0.3, **settings)).collect()}
    error = np.array([got[i] - y[i] for i in range(5, 300)])
    assert np.median(np.abs(error)) < 0.8 * np.median(np.abs(y[5:] - np.median(y)))


def expectation(trees, t, x, known, node=0):
    """Value of tree t where only the columns ``known`` are given: other cuts are averaged by cover."""
    c = trees.column[t, node]
    if c < 0:
        return trees.value[t, node]
    l, r = 2 * node + 1, 2 * node + 2  # noqa: E741
    if c in known:
        left = trees.missing_left[t, node] if np.isnan(x[c]) else x[c] <= trees.threshold[t, node]
        return expectation(trees, t, x, known, l if left else r)
    w = trees.cover[t, l] / (trees.cover[t, l] + trees.cover[t, r])
    return w * expectation(trees, t, x, known, l) + (1 - w) * expectation(trees, t, x, known, r)


def test_attribution_equals_all_subsets(spark):
    from strandloom.operators import attribution as A

    x, y = sample(200, 5, 4)
    df = rows_of(spark, x, y)
    model = B.fit_boosted(df, trees=4, depth=4, rate=0.5, least=2)
    m = model.members[0]
    found = {r.key: r for r in A.tree_attribution(df.where("key < 12"), A.boosted_paths(model, 0)).collect()}
    prediction = {r.key: r.prediction for r in B.boosted_predictions(df, model).collect()}
    for i in range(12):
        want = np.zeros(5)
        for j in range(5):
            others = [k for k in range(5) if k != j]
            for n in range(5):
                for s in itertools.combinations(others, n):
                    w = math.factorial(n) * math.factorial(4 - n) / math.factorial(5)
                    want[j] += w * sum(expectation(m.trees, t, x[i], {*s, j}) - expectation(m.trees, t, x[i], set(s)) for t in range(4))
        assert found[i].phi == pytest.approx(want.tolist(), abs=1e-9)
        assert sum(found[i].phi) + found[i].expectation == pytest.approx(prediction[i])
    mean = {r.pos: r.importance for r in A.mean_attribution(df, A.boosted_paths(model, 0), n_rows=10_000).collect()}
    every = A.tree_attribution(df, A.boosted_paths(model, 0)).collect()
    assert [mean[j] for j in range(5)] == pytest.approx(np.abs([r.phi for r in every]).mean(axis=0).tolist())
    some = A.mean_attribution(df, A.boosted_paths(model, 0), n_rows=20)
    assert some.count() == 5


def test_attribution_of_library_trees(spark, tmp_path):
    from strandloom.operators import attribution as A, models as M

    x, y = sample(200, 4, 5, missing=0.0)
    df = rows_of(spark, x, y)
    for name in ("tree", "forest", "gbt"):
        fitted = M.estimator(name, **({"maxDepth": 3, "numTrees": 3} if name == "forest" else {"maxDepth": 3})).fit(M._vectors(df))
        paths = A.library_paths(fitted, str(tmp_path / name))
        predicted = {r.key: r.prediction for r in fitted.transform(M._vectors(df)).select("key", "prediction").collect()}
        for r in A.tree_attribution(df.where("key < 20"), paths).collect():
            assert sum(r.phi) + r.expectation == pytest.approx(predicted[r.key])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "key long, fold int, label double, features array<double>")
    model = B.fit_boosted(empty, trees=2)
    assert B.boosted_predictions(empty, model).count() == 0
