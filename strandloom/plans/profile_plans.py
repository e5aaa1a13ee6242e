"""Profile queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import profiles as P
from strandloom.plans.registry import query
from strandloom.sources.tables import table

REGIONS = {"distal": (1, 16), "middle": (17, 48), "proximal": (49, 64)}

TIDY = """WITH p AS (SELECT vec_id AS id, CAST(i AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i))"""
REGION_SQL = """r AS (SELECT *, CASE WHEN pos <= 16 THEN 'distal' WHEN pos <= 48 THEN 'middle' ELSE 'proximal' END AS region FROM p)"""


def tidy(spark, sf_dir, **kw):
    return P.explode_profile(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", **kw)


def rounded(df, *keys):
    """Doubles to six decimals, so that the order of sums does not show."""
    return df.select(*keys, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query("regional_summary_b", f"""{TIDY}, {REGION_SQL}
SELECT id, region, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS lo, round(max(v), 6) AS hi,
  round(max(v) - min(v), 6) AS width, round(regr_slope(v, pos), 6) AS slope FROM r GROUP BY id, region""")
def regional_summary_b(spark, sf_dir):
    return rounded(P.regional_summary(tidy(spark, sf_dir), REGIONS), "id", "region")


NULLED = """WITH p AS (SELECT vec_id AS id, CAST(i AS INTEGER) AS pos, CASE WHEN abs(CAST(embedding[i] AS DOUBLE)) >= 0.02 THEN CAST(embedding[i] AS DOUBLE) END AS v
  FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i))"""


@query("regional_summary_a", f"""{NULLED}, {REGION_SQL},
f AS (SELECT *, coalesce(v, avg(v) OVER (PARTITION BY id, region)) AS filled FROM r)
SELECT id, region, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS lo, round(max(v), 6) AS hi,
  round(max(v) - min(v), 6) AS width, round(coalesce(regr_slope(filled, pos), 0), 6) AS slope FROM f GROUP BY id, region""")
def regional_summary_a(spark, sf_dir):
    return rounded(P.regional_summary(tidy(spark, sf_dir, null_below=0.02), REGIONS, "a"), "id", "region")


MEANS = """m AS (SELECT id, avg(CASE WHEN pos <= 16 THEN v END) AS distal, avg(CASE WHEN pos BETWEEN 17 AND 48 THEN v END) AS middle,
  avg(CASE WHEN pos >= 49 THEN v END) AS proximal FROM p GROUP BY id)"""


@query("regional_contrast", f"""{TIDY}, {MEANS} SELECT id, round(proximal - distal, 6) AS proximal_minus_distal,
  round(proximal - middle, 6) AS proximal_minus_middle, round(distal - middle, 6) AS distal_minus_middle FROM m""")
def regional_contrast(spark, sf_dir):
    means = P.region_means(tidy(spark, sf_dir), REGIONS)
    return rounded(P.contrasts(means, [("proximal", "distal"), ("proximal", "middle"), ("distal", "middle")]), "id")


@query("two_end_asymmetry", f"{TIDY} SELECT id, round(avg(CASE WHEN pos >= 60 THEN v END) - avg(CASE WHEN pos <= 5 THEN v END), 6) AS end_minus_start FROM p GROUP BY id")
def two_end_asymmetry(spark, sf_dir):
    means = P.region_means(tidy(spark, sf_dir), {"end": (60, 64), "start": (1, 5)})
    return rounded(P.contrasts(means, [("end", "start")]), "id")


@query("weighted_profile", f"""{NULLED}, w0 AS (
  SELECT 'linear' AS scheme, i AS pos, CAST(i AS DOUBLE) AS w FROM range(1, 65) t(i)
  UNION ALL SELECT 'quadratic', i, CAST(i * i AS DOUBLE) FROM range(1, 65) t(i)
  UNION ALL SELECT 'exponential', i, power(2.0, i / 8.0) FROM range(1, 65) t(i)
  UNION ALL SELECT 'seed_only', i, CASE WHEN i > 48 THEN 1.0 ELSE 0.0 END FROM range(1, 65) t(i)
  UNION ALL SELECT 'middle_proximal', i, CASE WHEN i <= 16 THEN 0.0 ELSE 1.0 END FROM range(1, 65) t(i)),
w AS (SELECT scheme, pos, w / sum(w) OVER (PARTITION BY scheme) AS w FROM w0),
s AS (SELECT id, scheme, sum(CASE WHEN v IS NOT NULL THEN w END) AS sw, sum(w * v) AS swv, sum(w * v * v) AS swvv, avg(v) AS plain,
  min(CASE WHEN w > 0 THEN v END) AS lo, max(CASE WHEN w > 0 THEN v END) AS hi FROM p JOIN w USING (pos) GROUP BY id, scheme)
SELECT id, scheme, round(swv / sw, 6) AS mean, round(sqrt(greatest(swvv / sw - (swv / sw) * (swv / sw), 0)), 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi,
  round(swv / sw - plain, 6) AS excess, round((swv / sw) / (abs(plain) + 1e-6), 6) AS ratio FROM s""")
def weighted_profile(spark, sf_dir):
    rows = [(s, p, w) for s, ws in P.position_weights(64).items() for p, w in enumerate(ws, 1)]
    out = P.weighted_statistics(tidy(spark, sf_dir, null_below=0.02), spark.createDataFrame(rows, "scheme string, pos int, w double"))
    return rounded(out, "id", "scheme")


NEIGHBOURS = "n AS (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY pos) AS b, lead(v) OVER (PARTITION BY id ORDER BY pos) AS a FROM p)"


@query("profile_jumps", f"""{NULLED}, {NEIGHBOURS} SELECT id, round(avg(abs(v - b)), 6) AS mean_abs, round(max(abs(v - b)), 6) AS max_abs,
  round(stddev_pop(v - b), 6) AS sd, round(sum(abs(v - b)), 6) AS total, round(avg(v - b), 6) AS mean FROM n GROUP BY id""")
def profile_jumps(spark, sf_dir):
    return rounded(P.jumps(tidy(spark, sf_dir, null_below=0.02)), "id")


@query("profile_curvature", f"""{TIDY}, {NEIGHBOURS} SELECT id, round(avg(abs(a - 2 * v + b)), 6) AS mean_abs, round(max(abs(a - 2 * v + b)), 6) AS max_abs,
  round(stddev_pop(a - 2 * v + b), 6) AS sd FROM n GROUP BY id""")
def profile_curvature(spark, sf_dir):
    return rounded(P.curvature(tidy(spark, sf_dir)), "id")


@query("local_extrema", f"""{TIDY}, {NEIGHBOURS} SELECT id, count(*) FILTER (v > b AND v > a) AS peaks, count(*) FILTER (v < b AND v < a) AS troughs FROM n GROUP BY id""")
def local_extrema(spark, sf_dir):
    return P.extrema(tidy(spark, sf_dir))


@query("hotspot", f"""{TIDY}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, pos) AS h, row_number() OVER (PARTITION BY id ORDER BY v, pos) AS l FROM p)
SELECT id, max(CASE WHEN h = 1 THEN pos END) AS peak_pos, 64 - max(CASE WHEN h = 1 THEN pos END) AS to_end, round(max(v), 6) AS peak,
  max(CASE WHEN l = 1 THEN pos END) AS trough_pos FROM o GROUP BY id""")
def hotspot(spark, sf_dir):
    return rounded(P.hotspot(tidy(spark, sf_dir), 64), "id")


@query("coupling_terms", f"""{TIDY}, m AS (SELECT id, avg(CASE WHEN pos <= 32 THEN v END) AS x, avg(CASE WHEN pos > 32 THEN v END) AS y FROM p GROUP BY id)
SELECT id, round(x * y, 6) + 0.0 AS product, round(x / (abs(y) + 1e-6), 6) AS ratio, round(x - y, 6) AS difference FROM m""")
def coupling_terms(spark, sf_dir):
    means = P.region_means(tidy(spark, sf_dir), {"x": (1, 32), "y": (33, 64)})
    return rounded(P.coupling(means, "x", "y"), "id")


@query("nonadditive_residual", f"""{TIDY}, {NEIGHBOURS}, u AS (SELECT id, pos, (v + a) / 2 AS v FROM n WHERE a IS NOT NULL),
x AS (SELECT id, CASE WHEN pos <= 16 THEN 'distal' WHEN pos <= 48 THEN 'middle' ELSE 'proximal' END AS region, avg(v) AS u FROM u GROUP BY ALL),
y AS (SELECT id, CASE WHEN pos <= 16 THEN 'distal' WHEN pos <= 48 THEN 'middle' ELSE 'proximal' END AS region, avg(v) AS l FROM p GROUP BY ALL)
SELECT id, region, round(u - l, 6) AS residual, round(abs(u - l), 6) AS size FROM x JOIN y USING (id, region)""")
def nonadditive_residual(spark, sf_dir):
    lower = tidy(spark, sf_dir)
    return rounded(P.residual_between(P.pair_means(lower), lower, REGIONS), "id", "region")


@query("phased_sum", f"""{TIDY} SELECT id, round(sqrt(power(sum(v * cos(2 * pi() * pos / 10.5)), 2) + power(sum(v * sin(2 * pi() * pos / 10.5)), 2)) / count(v), 6) AS bend FROM p GROUP BY id""")
def phased_sum(spark, sf_dir):
    return rounded(P.phased_sum(tidy(spark, sf_dir)), "id")


@query("median_filled_profile", f"""{NULLED}, m AS (SELECT pos, median(v) AS m FROM p GROUP BY pos)
SELECT id, round(avg(coalesce(v, m, 0)), 6) AS mean, count(v) AS present FROM p JOIN m USING (pos) GROUP BY id""")
def median_filled_profile(spark, sf_dir):
    profile = tidy(spark, sf_dir, null_below=0.02)
    filled = P.fill_with_column_median(profile).groupBy("id").agg(F.round(F.avg("v"), 6).alias("mean"))
    return filled.join(profile.groupBy("id").agg(F.count("v").alias("present")), "id")
