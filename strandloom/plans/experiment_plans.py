"""Experiment queries; their parts have oracles of their own, tests compare the whole with numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import boosting as B, experiments as E
from strandloom.plans.model_plans import rows
from strandloom.plans.registry import query
from strandloom.sources.workspace import stored


@query("ablation_permuted")
def ablation_permuted(spark, sf_dir):
    families = {"signal": [5, 6, 7], "noise": [20, 21, 22]}
    return E.ablation_report(stored(E.ablation_folds(rows(spark, sf_dir), [0, 1, 2], families, range(3), seeds=(0, 1)), "ablation"))


@query("tree_grid")
def tree_grid(spark, sf_dir):
    return E.tree_grid(rows(spark, sf_dir), range(2), (4, 16), (3, 8), rate=0.3)


@query("learning_curve")
def learning_curve(spark, sf_dir):
    return E.curve_summary(E.learning_curve(rows(spark, sf_dir), (0.25, 0.5, 1.0), (0, 1)))


@query("importance_directions")
def importance_directions(spark, sf_dir):
    r = rows(spark, sf_dir)
    return E.importance_panel(r, B.fit_boosted(r, range(2), trees=6, rate=0.3), 8)["direction"]


@query("hybrid_prior")
def hybrid_prior(spark, sf_dir):
    r = rows(spark, sf_dir, 4)
    target = r.where("fold < 2")
    return E.hybrid_scores(r.where("fold >= 2"), target.withColumn("fold", F.col("fold").cast("long")), range(2))
