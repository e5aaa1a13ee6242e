"""The zoo at its full size: every tree, component, neighbour and feature; trees grown in one task are those of one job a level."""

import numpy as np
import pytest

from strandloom.operators import block_matrix as X, boosting as B, models as M, regressors as R
from strandloom.plans import model_plans as P


def frame(spark, n=300, p=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[rng.random(x.shape) < 0.05] = np.nan
    y = np.where(np.isnan(x[:, 0]), 1.0, 2 * x[:, 0]) + np.where(x[:, 1] > 0.3, 3.0, -1.0) + 0.1 * rng.normal(size=n)
    data = [(i, i % 3, float(y[i]), [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(data, "key long, fold int, label double, features array<double>").repartition(3)


def test_zoo_comparison_asks_for_the_whole_work(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(P, "rows", lambda *a: None)
    monkeypatch.setattr(M, "compare_models", lambda df, models, folds, seed=0, settings=None: asked.update({m: dict(settings[m]) for m in models}))
    P.zoo_comparison(spark, "")
    assert asked["pls"]["components"] == 25 and asked["knn"]["k"] == 50
    assert asked["kernel"] == {"features": 800, "penalty": 1.0}
    for m in ("hist", "dart"):
        assert asked[m] == {"trees": 400, "rate": 0.05, "row_share": 1.0, "column_share": 1.0}


@pytest.mark.parametrize("settings", [{}, {"drop": 0.4}, {"objective": "huber"}, {"row_share": 1.0, "column_share": 1.0, "drop": 0.1}])
def test_trees_of_one_task_are_those_of_one_job_a_level(spark, monkeypatch, settings):
    df, found = frame(spark), []
    for inside in (B.INSIDE_BYTES, -1):
        monkeypatch.setattr(B, "INSIDE_BYTES", inside)
        found.append(B.fit_boosted(df, [0, 1, None], [0, 7], trees=9, depth=3, rate=0.3, refresh=4, **settings))
    for one, two in zip(found[0].members, found[1].members):
        assert one.grown == two.grown == 9 and np.array_equal(one.trees.column, two.trees.column) and np.array_equal(one.trees.code, two.trees.code)
        assert np.array_equal(one.trees.missing_left, two.trees.missing_left) and np.array_equal(one.trees.cover, two.trees.cover) and np.array_equal(one.trees.threshold, two.trees.threshold)
        for name in ("value", "gain"):
            assert getattr(one.trees, name) == pytest.approx(getattr(two.trees, name), rel=1e-6, abs=1e-9)
        assert np.array_equal(one.scale, two.scale) and ("drop" not in settings or (one.scale < 1).any())


def test_a_fit_of_many_trees_is_few_jobs(spark):
    df = frame(spark)
    spark.sparkContext.setJobGroup("whole-zoo", "")
    try:
        fitted = B.fit_boosted(df, range(3), trees=400, drop=0.1, row_share=1.0, column_share=1.0)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole-zoo"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40 and all(m.grown == 400 and (m.trees.cover[:, 0] == 200).all() for m in fitted.members)


def test_kernel_features_are_made_where_they_are_multiplied(spark, monkeypatch):
    df = frame(spark).selectExpr("key", "fold", "label", "transform(features, v -> coalesce(v, 0D)) AS features")
    width = R._width(df)
    total = sum(R.fold_moments(df, width).values())
    mean = total[2 : 2 + width] / total[0]
    scale = {"mean": mean, "sd": np.sqrt(total[2 + width :] / total[0] - mean**2)}
    want = {r.key: r.prediction for r in X.ridge_predictions(R.kernel_features(df, width, 30, 1 / width, scale, 0), 0.5).collect()}
    monkeypatch.setattr(R, "KERNEL_BLOCK", 8)
    monkeypatch.setattr(R, "kernel_features", None)
    got = {r.key: r.prediction for r in R.kernel_predictions(df, 30, penalty=0.5).collect()}
    assert got == pytest.approx(want)


def test_models_scored_together_as_alone(spark):
    df = frame(spark).selectExpr("key", "fold", "label", "transform(features, v -> coalesce(v, 0D)) AS features")
    settings = {"pls": {"components": 2}, "knn": {"k": 3}}
    together = M.compare_models(df, [*settings, "tree"], range(3), settings=settings)
    assert together.columns == ["fold", "n", "r2", "mse", "pearson", "spearman", "model"]
    got = {(r.model, r.fold): [r.n, r.r2, r.mse, r.pearson, r.spearman] for r in together.collect()}
    for name in [*settings, "tree"]:
        for r in M.fold_scores(M.zoo_predictions(df, range(3), name, **settings.get(name, {}))).collect():
            assert got[name, r.fold] == pytest.approx([r.n, r.r2, r.mse, r.pearson, r.spearman])
    assert len(got) == 9


def test_pls_components_beyond_the_signal_do_no_harm(spark):
    rng = np.random.default_rng(3)
    n, p = 6000, 40
    x = rng.normal(size=(n, p))
    y = x @ rng.normal(size=p) + rng.normal(size=n)
    df = spark.createDataFrame([(i, i % 3, float(y[i]), x[i].tolist()) for i in range(n)], "key long, fold int, label double, features array<double>")
    got = {r.key: r.prediction for r in R.pls_predictions(df, 25).collect()}
    for f in range(3):
        train = np.arange(n) % 3 != f
        a = np.column_stack([x, np.ones(n)])
        want = a[~train] @ np.linalg.lstsq(a[train], y[train], rcond=None)[0]
        assert [got[i] for i in np.flatnonzero(~train)] == pytest.approx(want.tolist(), abs=1e-6)
