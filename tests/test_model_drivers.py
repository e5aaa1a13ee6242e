"""Model drivers without an SQL form, on literal frames."""

import numpy as np
import pytest

from strandloom.operators import interpret as I, models as M
from strandloom.sources.workspace import work_folder


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 5))
    y = 3 * x[:, 1] - x[:, 4] + 0.1 * rng.normal(size=240)
    rows = [(i, i % 2, float(y[i]), x[i].tolist()) for i in range(240)]
    return x, y, spark.createDataFrame(rows, "key long, fold int, label double, features array<double>").repartition(3).cache()


def test_ranking_and_folds_see_training_rows_only(spark, frame):
    x, y, df = frame
    assert M.rank_features(df)[:2] == [1, 4]
    linear = {r.key: r.prediction for r in M.out_of_fold(df, [0, 1], 2, "linear").collect()}
    for f in (0, 1):
        train = np.arange(240) % 2 != f
        a = np.column_stack([x[:, [1, 4]], np.ones(240)])
        beta = np.linalg.lstsq(a[train], y[train], rcond=None)[0]
        assert [linear[i] for i in np.flatnonzero(~train)] == pytest.approx((a[~train] @ beta).tolist(), abs=1e-6)
    scores = {r.fold: r for r in M.fold_scores(M.out_of_fold(df, [0, 1], 2, "linear")).collect()}
    for f in (0, 1):
        held = np.arange(240) % 2 == f
        p = np.array([linear[i] for i in np.flatnonzero(held)])
        assert scores[f].mse == pytest.approx(((p - y[held]) ** 2).mean()) and scores[f].r2 == pytest.approx(1 - ((p - y[held]) ** 2).mean() / y[held].var())
        assert scores[f].pearson == pytest.approx(np.corrcoef(p, y[held])[0, 1])


def test_ablation_and_faithfulness_lose_where_signal_goes(spark, frame):
    _, _, df = frame
    arms = {(r.arm, r.fold): r.r2 for r in M.ablation(df, {"all": None, "signal": [1, 4], "noise": [0, 2]}, [0, 1], "linear").collect()}
    assert len(arms) == 6 and all(arms["signal", f] > 0.98 and arms["noise", f] < 0.1 for f in (0, 1))
    lost = {(r.arm, r.fold): r.r2 for r in M.faithfulness(df, [1, 4, 0, 2, 3], [1], [0, 1], "linear").collect()}
    assert set(a for a, _ in lost) == {"top", "random0", "random1"} and all(lost["top", f] < 0.3 for f in (0, 1))


def test_stack_transfer_and_saved_model(spark, frame):
    _, _, df = frame
    stacked = M.fold_scores(M.stacked(df, ["linear", "tree"], [0, 1])).collect()
    assert len(stacked) == 2 and all(r.r2 > 0.9 for r in stacked)
    moved = M.fold_scores(M.transfer(df.where("fold = 0"), df.where("fold = 1"), "linear")).collect()
    assert [r.fold for r in moved] == [1] and moved[0].r2 > 0.98
    path = work_folder(spark, "model")
    fitted = M.estimator("linear").fit(M._vectors(df, [1, 4]))
    M.save_model(fitted, path, [1, 4])
    again, columns = M.load_model(spark, path)
    assert columns == [1, 4]
    one, two = ({r.key: r.prediction for r in m.transform(M._vectors(df, columns)).select("key", "prediction").collect()} for m in (fitted, again))
    assert one == two


def test_search_and_iterative_forest(spark, frame):
    _, _, df = frame
    best, log = M.random_search(df, {"maxDepth": [1, 4]}, 4, 4, "tree", seed=2)
    assert max(s for _, s in log) == pytest.approx(next(s for c, s in log if c == best)) and {c["maxDepth"] for c, _ in log} <= {1, 4}
    members, weights = M.iterative_forest(df, 3, 4, share=0.6)
    assert len(members) == 4 and weights.sum() == pytest.approx(1) and set(np.argsort(-weights)[:2]) == {1, 4}
    found = M.forest_predictions(members, df)
    assert found.count() == 240 and M.fold_scores(found).where("r2 < 0.5").count() == 0


def test_gain_shares_and_clusters(spark, frame):
    _, _, df = frame
    shares = M.gain_shares(M.estimator("tree").fit(M._vectors(df)))
    assert sum(shares) == pytest.approx(1) and np.argmax(shares) == 1
    r = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.1), (4, 5, -0.95)], "i int, j int, r double")
    assert I.greedy_clusters(r, [1, 2, 3, 4, 5], 0.5) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert I.greedy_clusters(r, [2, 1, 3, 5, 4], 0.5) == {2: 2, 1: 2, 3: 2, 5: 5, 4: 5}
