"""Boosting and attribution queries. Only a first cut has a closed form in SQL; tests compare the rest with numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import attribution as A, boosting as B, models as M
from strandloom.plans.model_plans import rows
from strandloom.plans.registry import query
from strandloom.sources.workspace import work_folder

_ROWS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
f AS (SELECT vec_id, list_sum(e[33:40]) + 2 * e[1] - e[6] AS label, list_concat(e[1:32], e[41:]) AS x FROM e)"""


@query("boosted_first_cut", f"""{_ROWS}, y AS (SELECT avg(label) AS base FROM f),
t AS (SELECT CAST(i - 1 AS INTEGER) AS pos, x[i] AS v, base - label AS g FROM f, y, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)),
c AS (SELECT pos, v, count(*) OVER (PARTITION BY pos ORDER BY v) AS last, count(*) OVER (PARTITION BY pos) AS n FROM t),
k AS (SELECT pos, max(v) AS cut FROM c GROUP BY pos, (last - 1) * 64 // n),
s AS (SELECT t.pos, cut, sum(g) FILTER (v <= cut) AS gl, count(*) FILTER (v <= cut) AS hl, sum(g) AS g, count(*) AS h FROM t JOIN k USING (pos) GROUP BY t.pos, cut HAVING count(*) FILTER (v > cut) > 0),
w AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain FROM s)
SELECT pos, round(cut, 6) AS cut, round(gain, 3) AS gain, hl AS n_left, h - hl AS n_right, round(-0.05 * gl / (hl + 1), 6) AS left_value, round(-0.05 * (g - gl) / (h - hl + 1), 6) AS right_value
FROM w QUALIFY row_number() OVER (ORDER BY gain DESC, pos) = 1""")
def boosted_first_cut(spark, sf_dir):
    model = B.fit_boosted(rows(spark, sf_dir), trees=1, depth=1, row_share=1.0, column_share=1.0)
    t = model.members[0].trees
    found = [(int(t.column[0, 0]), float(t.threshold[0, 0]), float(t.gain[0, 0]), int(t.cover[0, 1]), int(t.cover[0, 2]), float(t.value[0, 1]), float(t.value[0, 2]))]
    out = spark.createDataFrame(found, "pos int, cut double, gain double, n_left long, n_right long, left_value double, right_value double")
    return out.select("pos", F.round("cut", 6).alias("cut"), F.round("gain", 3).alias("gain"), "n_left", "n_right", *[F.round(c, 6).alias(c) for c in ("left_value", "right_value")])


@query("champion_cv")
def champion_cv(spark, sf_dir):
    """Columns by gain and out-of-fold scores of boosted trees for every seed; fewer and faster trees than the default 400."""
    _, predictions = B.champion(rows(spark, sf_dir), range(3), (0, 1), top=16, trees=12, rate=0.3)
    return M.scores_by(predictions, ["seed", "fold"])


@query("tree_importance")
def tree_importance(spark, sf_dir):
    r = rows(spark, sf_dir)
    return A.mean_attribution(r, A.boosted_paths(B.fit_boosted(r, trees=12, rate=0.3), 0))


@query("library_tree_importance")
def library_tree_importance(spark, sf_dir):
    r = rows(spark, sf_dir)
    fitted = M.estimator("forest", numTrees=5, maxDepth=4).fit(M._vectors(r))
    return A.mean_attribution(r, A.library_paths(fitted, work_folder(spark, "trees")))
