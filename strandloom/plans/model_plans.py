"""Model queries: trees have no SQL; ridge regression on two columns has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import block_matrix as X, models as M, regressors as R
from strandloom.plans.registry import query
from strandloom.sources.tables import table
from strandloom.sources.workspace import stored, work_folder


def rows(spark, sf_dir, folds=3):
    """All components of each vector but 33 to 40 as features; the label is the sum of those eight and of two features."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    label = F.aggregate(F.slice("e", 33, 8), F.lit(0.0), lambda a, v: a + v) + F.col("e")[0] * 2 - F.col("e")[5]
    features = F.concat(F.slice("e", 1, 32), F.slice("e", F.lit(41), F.greatest(F.size("e") - 40, F.lit(0))))
    made = e.select(F.col("vec_id").alias("key"), label.alias("label"), features.alias("features"), F.pmod(F.xxhash64("vec_id"), F.lit(folds)).alias("fold"))
    return stored(made, "model-rows")


@query("oof_ridge")
def oof_ridge(spark, sf_dir):
    return M.fold_scores(M.out_of_fold_ridge(rows(spark, sf_dir), range(3)))


@query("ridge_redundancy", """WITH e AS (SELECT vec_id % 4 AS fold, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
r AS (SELECT fold, e[1] AS a, e[2] AS b, CAST(i - 3 AS BIGINT) AS target, CASE WHEN fold = 0 AND i % 9 = 0 THEN NULL WHEN i = 3 THEN 2 * e[1] - e[2] + e[3] / 4 ELSE e[i] END AS y FROM e, LATERAL (SELECT unnest(range(3, 65)) AS i)),
h AS (SELECT DISTINCT fold AS held FROM e),
m AS (SELECT held, target, avg(y) AS my FROM r, h WHERE fold <> held GROUP BY ALL),
f AS (SELECT held, target, a, b, coalesce(y, my) AS y FROM r JOIN m USING (target) WHERE fold <> held),
s AS (SELECT held, target, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) * count(*) + 1 AS aa, covar_pop(b, b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab,
  covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS cy FROM f GROUP BY ALL),
c AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS u, (cy * aa - ay * ab) / (aa * bb - ab * ab) AS v FROM s)
SELECT r.target, count(y) AS n, round(1 - sum(power(y - (my + u * (a - ma) + v * (b - mb)), 2)) / (var_pop(y) * count(y)), 6) AS r2 FROM r JOIN c ON c.target = r.target AND c.held = r.fold WHERE y IS NOT NULL GROUP BY r.target""")
def ridge_redundancy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("fold"), F.col("embedding").cast("array<double>").alias("e"))
    first = 2 * F.col("e")[0] - F.col("e")[1] + F.col("e")[2] / 4
    others = F.transform(F.slice("e", 4, 61), lambda v, k: F.when((F.col("fold") == 0) & ((k + 4) % 9 == 0), F.lit(None).cast("double")).otherwise(v))
    rows_ = e.select("fold", F.slice("e", 1, 2).alias("features"), F.concat(F.array(first), others).alias("targets"))
    return X.redundancy(stored(rows_, "redundancy-rows"), least=10).withColumn("r2", F.round("r2", 6))


@query("wide_redundancy")
def wide_redundancy(spark, sf_dir):
    """Half of the embedding from the squares, products and values of the other half: 560 columns, 32 targets."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("fold"), F.col("embedding").cast("array<double>").alias("e"))
    half = F.slice("e", 1, 32)
    pairs = F.flatten(F.transform(half, lambda a, i: F.transform(F.slice(half, i + 1, F.lit(33) - i - 1), lambda b: a * b)))
    return X.redundancy(stored(e.select("fold", F.concat(half, pairs).alias("features"), F.slice("e", 33, 32).alias("targets")), "redundancy-rows"), penalty=10.0, least=10)


@query("cv_gbt_top8")
def cv_gbt(spark, sf_dir):
    return M.fold_scores(M.out_of_fold(rows(spark, sf_dir, 2), range(2), 8))


@query("ablation_gbt")
def ablation_gbt(spark, sf_dir):
    return M.ablation(rows(spark, sf_dir, 2), {"all": None, "first": [0, 5], "noise": [1, 2]}, range(2), "tree")


@query("faithfulness_tree")
def faithfulness_tree(spark, sf_dir):
    r = rows(spark, sf_dir, 2)
    return M.faithfulness(r, M.rank_features(r.where("fold = 0")), [2, 8], range(2))


@query("model_comparison")
def model_comparison(spark, sf_dir):
    return M.compare_models(rows(spark, sf_dir, 2), ["tree", "ridge", "linear"], range(2))


@query("saved_model_scores")
def saved_model_scores(spark, sf_dir):
    r, path = rows(spark, sf_dir, 2), work_folder(spark, "model")
    M.save_model(M.estimator("tree").fit(M._vectors(r.where("fold = 0"), [0, 5, 7])), path, [0, 5, 7])
    fitted, columns = M.load_model(spark, path)
    return M.fold_scores(fitted.transform(M._vectors(r.where("fold = 1"), columns)))


@query("stacked_models")
def stacked_models(spark, sf_dir):
    return M.fold_scores(M.stacked(rows(spark, sf_dir, 2), ["tree", "ridge"], range(2)))


@query("transfer_gbt")
def transfer_gbt(spark, sf_dir):
    r = rows(spark, sf_dir, 2)
    return M.fold_scores(M.transfer(r.where("fold = 0"), r.where("fold = 1"), "tree"))


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    r = rows(spark, sf_dir, 2)
    fitted = M.estimator("tree").fit(M._vectors(r.where("fold = 0")))
    return M.permutation_importance(r.where("fold = 1"), fitted, range(len(r.first().features)))


@query("random_search_tree")
def random_search_tree(spark, sf_dir):
    _, log = M.random_search(rows(spark, sf_dir, 2).where("fold = 0"), {"maxDepth": [2, 3, 4], "minInstancesPerNode": [1, 5]}, 3, 2, "tree")
    return spark.createDataFrame([(i, c["maxDepth"], c["minInstancesPerNode"], float(s)) for i, (c, s) in enumerate(log)], "trial int, depth int, least int, rho double")


@query("iterative_forest")
def iterative_forest(spark, sf_dir):
    r = rows(spark, sf_dir, 2)
    members, _ = M.iterative_forest(r.where("fold = 0"), 2, 3)
    return M.fold_scores(M.forest_predictions(members, r.where("fold = 1")))


@query("zoo_comparison")
def zoo_comparison(spark, sf_dir):
    """Held-out scores of the regressors that the library lacks, on the same folds, each at its full size: 25 components, 50
    neighbours, 800 kernel features, 400 trees from all rows and columns."""
    every = {"trees": 400, "rate": 0.05, "row_share": 1.0, "column_share": 1.0}
    settings = {"pls": {"components": 25}, "knn": {"k": 50}, "kernel": {"features": 800, "penalty": 1.0}, "hist": every, "dart": every}
    return M.compare_models(rows(spark, sf_dir), list(settings), range(3), settings=settings)


@query("knn_regression", """WITH e AS (SELECT vec_id, label, vec_id % 3 AS fold, e[1] AS a, e[2] AS b FROM (SELECT vec_id, CAST(label AS DOUBLE) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)),
h AS (SELECT DISTINCT fold AS held FROM e), s AS (SELECT held, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM e, h WHERE fold <> held GROUP BY held),
d AS (SELECT q.vec_id, q.fold, o.vec_id AS o, o.label AS v, sqrt(power((q.a - o.a) / sa, 2) + power((q.b - o.b) / sb, 2)) AS d FROM e q JOIN e o ON o.fold <> q.fold JOIN s ON s.held = q.fold),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS n FROM d)
SELECT vec_id AS key, CAST(fold AS BIGINT) AS fold, round(CASE WHEN count(*) FILTER (d = 0) > 0 THEN avg(v) FILTER (d = 0) ELSE sum(v / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0) END, 5) AS prediction FROM r WHERE n <= 10 GROUP BY vec_id, fold""")
def knn_regression(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), F.pmod("vec_id", F.lit(3)).alias("fold"), F.col("label").cast("double").alias("label"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("features")
    )
    return R.knn_predictions(e, 10).select("key", "fold", F.round("prediction", 5).alias("prediction"))
