"""Ablation, grid, curve, panel and prior on literal frames."""

import numpy as np
import pytest

from strandloom.operators import boosting as B, experiments as E


def sample(spark, n=300, seed=1, first=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    y = x[:, 0] + 2 * x[:, 3] + 0.3 * rng.normal(size=n)
    return x, y, spark.createDataFrame([(first + i, i % 3, float(y[i]), x[i].tolist()) for i in range(n)], "key long, fold int, label double, features array<double>")


def test_permuted_columns_are_another_rows(spark):
    x, _, df = sample(spark, 120)
    rows = {r.key: r.features for r in E.with_permuted(df, [2, 4], 3).collect()}
    moved = np.array([rows[i] for i in range(120)])
    assert (moved[:, [0, 1, 3, 5]] == x[:, [0, 1, 3, 5]]).all() and not (moved[:, 2] == x[:, 2]).all()
    pairs = {tuple(r) for r in x[:, [2, 4]]}
    assert sorted(map(tuple, moved[:, [2, 4]])) == sorted(pairs)


def test_ablation_tells_signal_from_its_permutation(spark):
    _, _, df = sample(spark)
    scores = E.ablation_folds(df, [0, 1], {"signal": [3], "noise": [5]}, range(3), seeds=(0, 1))
    got = {(r.experiment, r.permuted): r for r in E.ablation_report(scores).collect()}
    assert set(got) == {("baseline", False), ("signal", False), ("signal", True), ("noise", False), ("noise", True)}
    assert got["signal", False].d_spearman > 0.3 and got["signal", False].folds_positive == 6 and got["signal", False].p < 0.001
    assert abs(got["signal", True].d_spearman) < 0.1 and abs(got["noise", False].d_r2) < 0.05
    assert got["baseline", False].d_r2 == 0 and got["baseline", False].folds == 6 and got["baseline", False].columns == 2
    base = [r.r2 for r in scores.where("experiment = 'baseline'").collect()]
    assert got["baseline", False].r2 == pytest.approx(np.mean(base)) and got["baseline", False].r2_sd == pytest.approx(np.std(base))


def test_grid_and_stages(spark):
    _, _, df = sample(spark, 240)
    model = B.fit_boosted(df, [0, 1, 2], trees=6, depth=2, rate=0.4)
    whole = {r.key: r.prediction for r in B.boosted_predictions(df, model).collect()}
    assert {r.key: r.prediction for r in E.staged_predictions(df, model, 6).collect()} == pytest.approx(whole)
    assert {r.key: r.prediction for r in E.staged_predictions(df, model, 2).collect()} != pytest.approx(whole) and model.members[0].grown == 6
    got = {r.top: r for r in E.tree_grid(df, [0, 1, 2], (1, 2), (2, 8), depth=2, rate=0.4).collect()}
    assert set(got) == {1, 2} and got[2].t8 > got[2].t2 and got[2].t8 > got[1].t8


def test_curve_grows_on_fixed_rows(spark):
    _, _, df = sample(spark, 400)
    curve = E.learning_curve(df, (0.1, 1.0), (0, 1)).collect()
    by = {(r.seed, r.share): r for r in curve}
    assert len(by) == 4 and all(by[s, 0.1].n == by[s, 1.0].n and by[s, 0.1].train < by[s, 1.0].train for s in (0, 1))
    assert all(by[s, 1.0].r2 > 0.9 for s in (0, 1))
    assert sorted(r.runs for r in E.curve_summary(E.learning_curve(df, (0.5,), (0, 1))).collect()) == [2]


def test_panel(spark):
    _, _, df = sample(spark, 240)
    panel = {k: v.collect() for k, v in E.importance_panel(df, B.fit_boosted(df, [0, 1], trees=8, depth=2, rate=0.4), 2).items()}
    assert [r["index"] for r in panel["stability"]] == [pytest.approx(1.0)]
    assert len(panel["agreement"]) == 6 and all(r.rho > 0.3 for r in panel["agreement"])
    direction = {r.pos: r for r in panel["direction"]}
    assert direction[3].direction > 0.8 and direction[3]["size"] > direction[0]["size"] > direction[5]["size"]
    assert 1 <= panel["concentration"][0].effective < 4


def test_a_prior_helps_a_small_target(spark):
    _, _, source = sample(spark, 300, 2)
    _, y, target = sample(spark, 18, 3, first=1000)
    got = {(r.arm, r.fold): r for r in E.hybrid_scores(source, target, range(3)).collect()}
    assert len(got) == 9 and np.mean([got["transfer", f].r2 for f in range(3)]) > 0.8
    assert np.mean([got["hybrid", f].mse for f in range(3)]) < np.mean([got["own", f].mse for f in range(3)])
