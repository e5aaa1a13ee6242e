"""Experiments over models: ablation with permuted controls, grids, learning curves, the panel of importances, prior columns.

Rows are (key, fold, label, features array<double>). Loops run over arms, seeds and sizes only; each fit and score is a plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from strandloom.operators.aggregates import concentration, kuncheva, paired_t
from strandloom.operators.attribution import boosted_paths, tree_attribution
from strandloom.operators.boosting import Boosted, boosted_predictions, fit_boosted, top_columns
from strandloom.operators.interpret import importance_agreement
from strandloom.operators.models import scores_by, zoo_predictions
from strandloom.operators.resampling import draw, permuted
from strandloom.sources.workspace import stored


def _cut(df: DataFrame, columns: Sequence[int]) -> DataFrame:
    return df.withColumn("features", F.array(*[F.col("features")[int(c)] for c in columns]))


def with_permuted(df: DataFrame, columns: Sequence[int], seed: int) -> DataFrame:
    """Rows whose ``columns`` come from another row, all of one row together; the rest is their own (ML-14)."""
    other = permuted(df.select("key", F.col("features").alias("other")), "key", ["other"], seed)
    moved = F.array(*[F.lit(int(c)) for c in columns])
    mixed = F.transform(F.arrays_zip("features", "other"), lambda x, i: F.when(F.array_contains(moved, i), x["other"]).otherwise(x["features"]))
    return df.join(other, "key").withColumn("features", mixed).drop("other")


def ablation_folds(
    df: DataFrame, baseline: Sequence[int], families: Mapping[str, Sequence[int]], folds: Sequence[int], seeds: Sequence[int] = (0,), model: str = "block_ridge", permute: bool = True, **settings,
) -> DataFrame:
    """(experiment, permuted, columns, seed, fold, n, r2, mse, pearson, spearman): the baseline's columns alone, with each family,
    and with each family's columns permuted over the rows, on the same folds (ML-13)."""
    arms = [("baseline", False, list(baseline), [])]
    for name, own in families.items():
        arms.append((name, False, [*baseline, *own], []))
        if permute:
            arms.append((name, True, [*baseline, *own], list(own)))
    out = None
    for name, control, columns, moved in arms:
        for seed in seeds:
            rows = _cut(with_permuted(df, moved, seed) if moved else df, columns)
            scores = scores_by(zoo_predictions(rows, folds, model, seed, **settings), ["fold"])
            part = scores.select(F.lit(name).alias("experiment"), F.lit(control).alias("permuted"), F.lit(len(columns)).alias("columns"), F.lit(int(seed)).alias("seed"), *scores.columns)
            out = part if out is None else out.unionByName(part)
    return out


def ablation_report(scores: DataFrame) -> DataFrame:
    """(experiment, permuted, columns, folds, r2, r2_sd, spearman, spearman_sd, d_r2, d_spearman, folds_positive, t, p): means over folds
    and seeds, gains over the baseline of the same seed and fold, and their paired t-test (AG-18, JN-06)."""
    groups = ["experiment", "permuted", "columns"]
    base = scores.where("experiment = 'baseline'").select("seed", "fold", F.col("r2").alias("__r2"), F.col("spearman").alias("__rho"))
    both = scores.join(base, ["seed", "fold"], "left").withColumn("d", F.col("spearman") - F.col("__rho"))
    sums = both.groupBy(*groups).agg(
        F.count("*").alias("folds"), F.avg("r2").alias("r2"), F.stddev_pop("r2").alias("r2_sd"), F.avg("spearman").alias("spearman"), F.stddev_pop("spearman").alias("spearman_sd"),
        F.avg(F.col("r2") - F.col("__r2")).alias("d_r2"), F.avg("d").alias("d_spearman"), F.count_if(F.col("d") > 0).alias("folds_positive"),
    )
    return sums.join(paired_t(both, groups, "d").select(*groups, "t", "p"), groups)


def staged_predictions(df: DataFrame, model: Boosted, trees: int) -> DataFrame:
    """Predictions of the members' first ``trees`` trees."""
    grown = [m.grown for m in model.members]
    for m in model.members:
        m.grown = min(m.grown, trees)
    try:
        return boosted_predictions(df, Boosted(model.cuts, [_copied(m) for m in model.members]))
    finally:
        for m, g in zip(model.members, grown):
            m.grown = g


def _copied(member):
    from dataclasses import replace

    return replace(member)


def tree_grid(df: DataFrame, folds: Sequence[int], tops: Sequence[int], trees: Sequence[int], seed: int = 0, **settings) -> DataFrame:
    """(top, t<trees>...): mean out-of-fold R2 by number of columns and of trees, side by side (ML-20).

    Columns are ranked once outside each fold; a row's models are grown once and scored at each number of trees.
    """
    ranked, out = fit_boosted(df, folds, [seed], max(trees), **settings), None
    for top in tops:
        model = fit_boosted(df, folds, [seed], max(trees), columns=top_columns(ranked, top), **settings)
        for t in trees:
            part = scores_by(staged_predictions(df, model, t), ["fold"]).agg(F.avg("r2").alias("r2")).select(F.lit(int(top)).alias("top"), F.lit(f"t{t}").alias("trees"), "r2")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("top").pivot("trees", [f"t{t}" for t in trees]).agg(F.first("r2"))


def learning_curve(df: DataFrame, shares: Sequence[float], seeds: Sequence[int], test_share: float = 0.2, model: str = "block_ridge", **settings) -> DataFrame:
    """(seed, share, train, n, r2, mse, pearson, spearman): growing samples of one shuffled order, scored on the same held-out rows (ML-21).

    ``shares`` are shares of the rows that are not held out; a smaller sample is part of a larger one.
    """
    out = None
    for seed in seeds:
        place = draw(seed, F.col("key")) / F.lit(2.0**32)
        marked = stored(df.withColumn("__u", place), "learning-curve")
        held = marked.where(F.col("__u") >= 1 - test_share).withColumn("fold", F.lit(1))
        for share in shares:
            train = marked.where(F.col("__u") < (1 - test_share) * share).withColumn("fold", F.lit(0))
            both = stored(train.unionByName(held).drop("__u"), "learning-curve")
            n = both.where("fold = 0").count()
            scored = scores_by(zoo_predictions(both, [0, 1], model, seed, **settings).where("fold = 1"), ["fold"]).drop("fold")
            part = scored.select(F.lit(int(seed)).alias("seed"), F.lit(float(share)).alias("share"), F.lit(n).alias("train"), *scored.columns)
            out = part if out is None else out.unionByName(part)
    return out


def curve_summary(curve: DataFrame) -> DataFrame:
    """(share, runs, mean and spread of the scores over seeds)."""
    return curve.groupBy("share").agg(F.count("*").alias("runs"), *[c for m in ("r2", "spearman", "pearson") for c in (F.avg(m).alias(m), F.stddev_samp(m).alias(f"{m}_sd"))])


def importance_panel(df: DataFrame, model: Boosted, top: int) -> dict[str, DataFrame]:
    """Stability, agreement, concentration and direction of a model's importances (ML-23).

    ``stability``: chance-corrected overlap of every two members' ``top`` columns by gain. ``agreement``: rank correlation of gain and of
    mean attribution, by member pairs and methods. ``concentration``: effective number of columns by attribution.
    ``direction``: mean attribution, its size and its correlation with the column's value.
    """
    spark = df.sparkSession
    width = len(model.cuts)
    sets = [(i, int(c)) for i, m in enumerate(model.members) for c in top_columns(Boosted(model.cuts, [m]), top)[m.fold, m.seed]]
    gains = [(f"gain{i}", j, float(g)) for i, m in enumerate(model.members) for j, g in enumerate(Boosted(model.cuts, [m]).gains())]  # columns times members
    values = None
    for i in range(len(model.members)):
        part = tree_attribution(df, boosted_paths(model, i)).join(df.select("key", "features"), "key").select(F.lit(i).alias("member"), F.posexplode(F.arrays_zip("phi", "features")).alias("pos", "x"))
        part = part.select("member", "pos", F.col("x.phi").alias("phi"), F.col("x.features").alias("v"))
        values = part if values is None else values.unionByName(part)
    values = stored(values, "attributions")
    sizes = values.groupBy("member", "pos").agg(F.avg(F.abs("phi")).alias("value"))
    shap = sizes.select(F.concat(F.lit("attribution"), F.col("member").cast("string")).alias("model"), "pos", "value")
    pooled = values.groupBy("pos").agg(
        F.avg("phi").alias("mean"), F.avg(F.abs("phi")).alias("size"), F.coalesce(F.try_divide(F.covar_pop("v", "phi"), F.stddev_pop("v") * F.stddev_pop("phi")), F.lit(0.0)).alias("direction")
    )
    return {
        "stability": kuncheva(spark.createDataFrame(sets, "fold int, item int"), "fold", "item", width),
        "agreement": importance_agreement(spark.createDataFrame(gains, "model string, pos int, value double").unionByName(shap)),
        "concentration": concentration(pooled, "pos", "size"),
        "direction": pooled,
    }


def with_prior(source: DataFrame, target: DataFrame, model: str = "block_ridge", seed: int = 0, **settings) -> DataFrame:
    """The target's rows with one more feature: the prediction of a model fitted on the source alone (ML-36)."""
    both = source.select("key", F.lit(0).alias("fold"), "label", "features").withColumn("__own", F.lit(False)).unionByName(
        target.select("key", F.lit(1).alias("fold"), "label", "features").withColumn("__own", F.lit(True))
    )
    rows = stored(both, "prior-rows")
    prior = zoo_predictions(rows.drop("__own"), [0, 1], model, seed, **settings).where("fold = 1").select("key", F.col("prediction").alias("__prior"))
    return target.join(prior, "key").withColumn("features", F.concat("features", F.array("__prior"))).drop("__prior")


def hybrid_scores(source: DataFrame, target: DataFrame, folds: Sequence[int], model: str = "block_ridge", seed: int = 0, **settings) -> DataFrame:
    """(arm, fold, scores) on the target: transfer of the source's model, the target's own columns, and those with the prior (ML-36)."""
    held = stored(with_prior(source, target, model, seed, **settings), "hybrid-rows")
    width = F.size("features")
    arms = {
        "transfer": held.select("key", "fold", "label", F.element_at("features", -1).alias("prediction")),
        "own": zoo_predictions(held.withColumn("features", F.slice("features", F.lit(1), width - 1)), folds, model, seed, **settings),
        "hybrid": zoo_predictions(held, folds, model, seed, **settings),
    }
    out = None
    for name, predictions in arms.items():
        scored = scores_by(predictions.where(F.col("fold").isin(*folds)), ["fold"])
        part = scored.select(F.lit(name).alias("arm"), *scored.columns)
        out = part if out is None else out.unionByName(part)
    return out
