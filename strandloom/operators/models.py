"""Model operators (ML-08..13, 16, 17, 24, 26, 31, 36) with ``pyspark.ml``. Every statistic of a fold is fitted outside it.

Rows are (key, label, features array<double>, fold). Loops run over folds, arms and seeds only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, FMRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.operators.aggregates import pearson, spearman_by
from strandloom.operators.block_matrix import ridge_predictions
from strandloom.operators.boosting import boosted_predictions, fit_boosted
from strandloom.operators.regressors import kernel_predictions, knn_predictions, pls_predictions
from strandloom.operators.resampling import permuted
from strandloom.sources.workspace import stored


def estimator(name: str, seed: int = 0, **more):
    """One factory for the regressors that Spark has (ML-16)."""
    made: Mapping[str, Callable] = {
        "gbt": lambda: GBTRegressor(maxIter=10, maxDepth=4, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
        "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed),
        "tree": lambda: DecisionTreeRegressor(maxDepth=5, seed=seed),
        "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0),
        "linear": lambda: LinearRegression(),
        "fm": lambda: FMRegressor(maxIter=20, seed=seed),
    }
    if name not in made:
        raise ValueError(f"unknown model {name}; known: {sorted(made)}")
    return made[name]().copy().setParams(labelCol="label", featuresCol="x", **more)


def _vectors(df: DataFrame, columns: Sequence[int] | None = None) -> DataFrame:
    """Features as a vector, cut to the chosen 0-based columns."""
    held = F.col("features") if columns is None else F.array(*[F.col("features")[int(c)] for c in columns])
    return df.withColumn("x", array_to_vector(held))


def rank_features(train: DataFrame, seed: int = 0) -> list[int]:
    """0-based columns by falling gain in boosted trees fitted on the training rows alone (ML-08)."""
    gains = estimator("gbt", seed).fit(_vectors(train)).featureImportances.toArray()
    return sorted(range(len(gains)), key=lambda i: (-gains[i], i))


def out_of_fold(df: DataFrame, folds: Sequence[int], top: int | None, model: str = "gbt", seed: int = 0) -> DataFrame:
    """(key, fold, label, prediction): features chosen and model fitted outside each fold (ML-09, ML-10, ML-12)."""
    out = None
    for f in folds:
        train, held = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
        columns = rank_features(train, seed)[:top] if top else None
        fitted = estimator(model, seed).fit(_vectors(train, columns))
        part = fitted.transform(_vectors(held, columns)).select("key", "fold", "label", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def scores_by(predictions: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, n, r2, mse, pearson, spearman) of held-out predictions (AG-15, AG-17)."""
    predictions = stored(predictions, "predictions")  # ranks read them several times, the models predict once
    e = F.col("label") - F.col("prediction")
    plain = predictions.groupBy(*groups).agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.avg(e * e), F.var_pop("label"))).alias("r2"), F.avg(e * e).alias("mse"), pearson("label", "prediction").alias("pearson")
    )
    return plain.join(spearman_by(predictions, list(groups), "label", "prediction").select(*groups, F.col("rho").alias("spearman")), list(groups))


def fold_scores(predictions: DataFrame) -> DataFrame:
    """``scores_by`` fold."""
    return scores_by(predictions, ["fold"])


def ablation(df: DataFrame, arms: Mapping[str, Sequence[int] | None], folds: Sequence[int], model: str = "gbt", seeds: Sequence[int] = (0,)) -> DataFrame:
    """(arm, seed, fold, scores) for sets of columns, the same folds for all (ML-13, ML-20, ML-34)."""
    out = None
    for arm, columns in arms.items():
        cut = df if columns is None else df.withColumn("features", F.array(*[F.col("features")[int(c)] for c in columns]))
        for s in seeds:
            part = fold_scores(out_of_fold(cut, folds, None, model, s)).withColumn("arm", F.lit(arm)).withColumn("seed", F.lit(s))
            out = part if out is None else out.unionByName(part)
    return out


def stacked(df: DataFrame, members: Sequence[str], folds: Sequence[int], seed: int = 0) -> DataFrame:
    """Ridge over the members' out-of-fold predictions, itself out of fold (ML-17)."""
    base = df.select("key", "fold", "label")
    for m in members:
        base = base.join(out_of_fold(df, folds, None, m, seed).select("key", F.col("prediction").alias(m)), "key")
    return out_of_fold(base.select("key", "fold", "label", F.array(*members).alias("features")), folds, None, "ridge", seed)


def transfer(source: DataFrame, target: DataFrame, model: str = "gbt", seed: int = 0) -> DataFrame:
    """Fitted on one screen, applied to another (ML-36, ML-37)."""
    return estimator(model, seed).fit(_vectors(source)).transform(_vectors(target)).select("key", "fold", "label", "prediction")


def permutation_importance(df: DataFrame, fitted, columns: Sequence[int], seed: int = 0) -> DataFrame:
    """(column, drop): fall of the rank correlation when a column's values are permuted over all rows (ML-24).

    One permutation gives every row another row; each variant takes one slot from it.
    """
    other = permuted(df.select("key", F.col("features").alias("other")), "key", ["other"], seed)
    spread = df.join(other, "key").withColumn("column", F.explode(F.array(F.lit(-1), *[F.lit(int(c)) for c in columns])))
    moved = F.zip_with("features", "other", lambda v, o: F.struct(v.alias("v"), o.alias("o")))
    taken = F.transform(moved, lambda x, i: F.when(i == F.col("column"), x["o"]).otherwise(x["v"]))
    spread = spread.select("key", "fold", "label", "column", taken.alias("features"))
    predictions = stored(fitted.transform(_vectors(spread)).select("column", "label", "prediction"), "permuted")
    rho = spearman_by(predictions, ["column"], "label", "prediction")
    full = rho.where("column = -1").select(F.col("rho").alias("full"))
    return rho.where("column >= 0").join(F.broadcast(full)).select("column", (F.col("full") - F.col("rho")).alias("drop"))  # one row


def gain_shares(fitted) -> list[float]:
    """Importances as shares of their sum, all zero where none has any (ML-26)."""
    g = np.asarray(fitted.featureImportances.toArray(), dtype=float)
    return (g / g.sum() if g.sum() > 0 else g).tolist()


def out_of_fold_ridge(df: DataFrame, folds: Sequence[int], penalty: float = 1.0) -> DataFrame:
    """(key, fold, label, prediction) by ridge regression with a free intercept, fitted outside each fold (AG-33)."""
    return ridge_predictions(df.where(F.col("fold").isin(*folds)), penalty)


def random_search(train: DataFrame, space: Mapping[str, Sequence], draws: int, patience: int, model: str = "gbt", seed: int = 0) -> tuple[dict, list[tuple[dict, float]]]:
    """Best settings and the log of draws (ML-19): scored on a fifth of the training rows, stopped after ``patience``
    draws without a better one. The held-out fold takes no part."""
    rng = np.random.default_rng(seed)
    marked = train.withColumn("part", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(5)))
    fit, check = _vectors(marked.where("part > 0")), _vectors(marked.where("part = 0"))
    best, since, log = (-np.inf, {}), 0, []
    for _ in range(draws):
        settings = {k: v[int(rng.integers(len(v)))] for k, v in space.items()}
        scored = stored(estimator(model, seed, **settings).fit(fit).transform(check).select("label", "prediction"), "trial")
        rho = spearman_by(scored, [], "label", "prediction").first()
        score = rho.rho if rho and rho.rho is not None else 0.0
        log.append((settings, score))
        best, since = ((score, settings), 0) if score > best[0] else (best, since + 1)
        if since >= patience:
            break
    return best[1], log


def iterative_forest(train: DataFrame, rounds: int, trees: int, share: float = 0.5, seed: int = 0) -> tuple[list, np.ndarray]:
    """Rounds of trees on columns drawn by the last round's importances, w -> 0.9 w + 0.1 / p (ML-18).

    Gives the last round's (columns, tree) members and the weights; a prediction is the members' mean.
    """
    p = len(train.select("features").first()[0])
    rng, weights = np.random.default_rng(seed), np.full(p, 1.0 / p)
    members: list = []
    for _ in range(rounds):
        gains, members = np.zeros(p), []
        for t in range(trees):
            columns = sorted(rng.choice(p, size=max(1, int(share * p)), replace=False, p=weights).tolist())
            bag = train.sample(withReplacement=True, fraction=1.0, seed=int(rng.integers(1 << 31)))
            fitted = estimator("tree", seed + t).fit(_vectors(bag, columns))
            gains[columns] += fitted.featureImportances.toArray()
            members.append((columns, fitted))
        weights = 0.9 * (gains / gains.sum() if gains.sum() > 0 else weights) + 0.1 / p
        weights /= weights.sum()
    return members, weights


def forest_predictions(members: list, df: DataFrame) -> DataFrame:
    """(key, fold, label, prediction): mean over the members of an iterative forest."""
    out = None
    for columns, fitted in members:
        part = fitted.transform(_vectors(df, columns)).select("key", "fold", "label", "prediction")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("key", "fold", "label").agg(F.avg("prediction").alias("prediction"))


def save_model(fitted, path: str, columns: Sequence[int] = ()) -> None:
    """The fitted model and the columns it reads, in a new folder that all executors share (SRC-13, SNK-04)."""
    fitted.write().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([([int(c) for c in columns],)], "columns array<int>").coalesce(1).write.parquet(f"{path}/columns")


def load_model(spark: SparkSession, path: str):
    """(model, columns) as saved (SRC-13)."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark), list(spark.read.parquet(f"{path}/columns").first()[0])


def faithfulness(df: DataFrame, ranked: Sequence[int], steps: Sequence[int], folds: Sequence[int], model: str = "tree", seed: int = 0) -> DataFrame:
    """(arm, dropped, fold, n, mse, r2) of models fitted again without their leading columns (ML-30).

    The arm ``top`` drops the first ``steps`` columns of the ranking; the arms ``random0`` and ``random1`` drop as many
    drawn by a seed. A ranking is faithful where its arm loses more than both.
    """
    rng, everything, out = np.random.default_rng(seed), sorted(ranked), None
    for k in steps:
        arms = {"top": set(ranked[:k]), **{f"random{i}": set(rng.choice(everything, size=k, replace=False).tolist()) for i in (0, 1)}}
        scores = ablation(df, {name: [c for c in everything if c not in gone] for name, gone in arms.items()}, folds, model)
        part = scores.withColumn("dropped", F.lit(int(k)))
        out = part if out is None else out.unionByName(part)
    return out


def zoo_predictions(df: DataFrame, folds: Sequence[int], model: str, seed: int = 0, **settings) -> DataFrame:
    """(key, fold, label, prediction), out of fold, of any regressor of the zoo (ML-16): those of ``estimator``, and histogram
    boosting plain (``hist``), with dropout (``dart``) or Huber's loss (``huber``), partial least squares (``pls``), nearest
    neighbours (``knn``), random kernel features (``kernel``) and block ridge (``block_ridge``)."""
    held = df.where(F.col("fold").isin(*folds))
    boosted = {"hist": {}, "dart": {"drop": 0.1}, "huber": {"objective": "huber"}}
    if model in boosted:
        fitted = fit_boosted(held, folds, [seed], **boosted[model], **settings)
        return boosted_predictions(held, fitted).drop("seed")
    others = {"pls": pls_predictions, "knn": knn_predictions, "kernel": kernel_predictions, "block_ridge": ridge_predictions}
    return others[model](held, **settings) if model in others else out_of_fold(df, folds, None, model, seed)


def compare_models(df: DataFrame, models: Sequence[str], folds: Sequence[int], seed: int = 0, settings: Mapping[str, Mapping] | None = None) -> DataFrame:
    """(fold, n, r2, mse, pearson, spearman, model) of several models on the same folds and columns (ML-22, ML-35), scored together."""
    out = None
    for name in models:
        part = zoo_predictions(df, folds, name, seed, **(settings or {}).get(name, {})).select("key", "fold", "label", "prediction", F.lit(name).alias("model"))
        out = part if out is None else out.unionByName(part)
    return scores_by(out, ["model", "fold"]).select("fold", "n", "r2", "mse", "pearson", "spearman", "model")
