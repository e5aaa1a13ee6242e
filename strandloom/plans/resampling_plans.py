"""Resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import resampling as R
from strandloom.plans.registry import query
from strandloom.sources.tables import table


def RANK(seed, key):
    return f"row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) - 1"


@query("kfold_cover", f"""WITH f AS (SELECT event_id, ({RANK(3, 'event_id')}) % 5 AS fold FROM events) SELECT fold, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS keys FROM f GROUP BY fold""")
def kfold_cover(spark, sf_dir):
    e = R.exact_folds(table(spark, sf_dir, "events").select("event_id"), "event_id", 5, 3)
    return e.groupBy("fold").agg(F.count("*").alias("n"), F.sum("event_id").alias("keys"))


@query("random_folds", "SELECT event_id, CAST('0x' || substr(md5('3:' || event_id), 1, 8) AS BIGINT) % 5 AS fold FROM events")
def random_folds(spark, sf_dir):
    return R.random_folds(table(spark, sf_dir, "events").select("event_id"), "event_id", 5, 3)


@query("grouped_folds", f"""WITH g AS (SELECT user_id, {RANK(3, 'user_id')} AS r FROM (SELECT DISTINCT user_id FROM events)), n AS (SELECT count(*) % 5 AS big, count(*) // 5 AS size FROM g)
SELECT event_id, user_id, CAST(CASE WHEN r < big * (size + 1) THEN r // (size + 1) ELSE big + (r - big * (size + 1)) // size END AS BIGINT) AS fold FROM events JOIN g USING (user_id), n""")
def grouped_folds(spark, sf_dir):
    return R.grouped_folds(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 5, 3).select("event_id", "user_id", "fold")


@query("balanced_group_folds", """WITH s AS (SELECT o_custkey, count(*) AS n, md5(CAST(o_custkey AS VARCHAR)) AS d FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, substr(d, 1, 3), d, o_custkey) - 1 AS r FROM s),
f AS (SELECT n, CASE WHEN r // 7 % 2 = 0 THEN r % 7 ELSE 6 - r % 7 END AS fold FROM r)
SELECT CAST(fold AS BIGINT) AS fold, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups FROM f GROUP BY 1""")
def balanced_group_folds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return R.balanced_group_folds(o, "o_custkey", 7).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query("arc_groups", "SELECT event_id, CAST((event_id * 37 % 100003) // 5000 AS BIGINT) AS bin, least(CAST(floor((event_id * 37 % 100003) / (100003 / 5.0::DOUBLE)) AS BIGINT), 4) AS arc FROM events")
def arc_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 100003 + 1).alias("p"))
    return R.spatial_groups(e, "p", 5000, 100003).select("event_id", "bin", F.col("arc").cast("long").alias("arc"))


STATS = """WITH r AS (SELECT o_orderkey, o_orderkey % 5 AS fold, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS value FROM orders),
s AS (SELECT h AS fold, coalesce(median(value), 0) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_pop(value) AS sd FROM r, range(0, 5) t(h) WHERE r.fold <> h GROUP BY h)"""


def _fitted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("fold"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("price"))
    rows = R.tidy(o, ["o_orderkey", "fold"], ["price"])
    return R.apply_train_statistics(rows, R.train_statistics(rows, "fold", 5), "fold")


@query("median_impute_by_fold", f"{STATS} SELECT o_orderkey, fold, round(coalesce(value, med), 4) AS filled FROM r JOIN s USING (fold)")
def median_impute_by_fold(spark, sf_dir):
    return _fitted(spark, sf_dir).select("o_orderkey", "fold", F.round("filled", 4).alias("filled"))


@query("iqr_winsorize", f"""{STATS} SELECT o_orderkey, fold, round(greatest(least(coalesce(value, med), q3 + CASE WHEN q3 > q1 THEN 3 * (q3 - q1) ELSE 3 END), q1 - CASE WHEN q3 > q1 THEN 3 * (q3 - q1) ELSE 3 END), 4) AS clipped FROM r JOIN s USING (fold)""")
def iqr_winsorize(spark, sf_dir):
    return _fitted(spark, sf_dir).select("o_orderkey", "fold", F.round("clipped", 4).alias("clipped"))


@query("standardize_train", f"{STATS} SELECT o_orderkey, fold, round((coalesce(value, med) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS scaled FROM r JOIN s USING (fold)")
def standardize_train(spark, sf_dir):
    return _fitted(spark, sf_dir).select("o_orderkey", "fold", F.round("scaled", 6).alias("scaled"))


@query("joint_permutation", f"""WITH k AS (SELECT p_partkey, {RANK(-1, 'p_partkey')} AS r FROM part), v AS (SELECT p_brand, p_size, {RANK(9, 'p_partkey')} AS r FROM part)
SELECT p_partkey, p_brand, p_size FROM k JOIN v USING (r)""")
def joint_permutation(spark, sf_dir):
    return R.permuted(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"], 9)


@query("column_permutation", f"""WITH k AS (SELECT p_partkey, {RANK(-1, 'p_partkey')} AS r FROM part), a AS (SELECT p_brand, {RANK(9, 'p_partkey')} AS r FROM part), b AS (SELECT p_size, {RANK(10, 'p_partkey')} AS r FROM part)
SELECT p_partkey, p_brand, p_size FROM k JOIN a USING (r) JOIN b USING (r)""")
def column_permutation(spark, sf_dir):
    return R.permuted_each(table(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_size"], 9)


U = "((CAST('0x' || substr(md5('{}:' || p_partkey), 1, 8) AS BIGINT) + 1) / (power(2.0::DOUBLE, 32) + 1))"


@query("noise_control", f"SELECT p_partkey, round(sqrt(-2 * ln({U.format(5)})) * cos(6.283185307179586 * {U.format(6)}), 6) AS z FROM part")
def noise_control(spark, sf_dir):
    return R.noise(table(spark, sf_dir, "part"), "p_partkey", ["z"], 5).select("p_partkey", F.round("z", 6).alias("z"))


@query("learning_curve_sample", """SELECT share, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS keys FROM events, (VALUES (0.1), (0.2), (0.4), (0.8)) t(share)
WHERE CAST('0x' || substr(md5('4:' || event_id), 1, 8) AS BIGINT) < floor(share::DOUBLE * 4294967296) GROUP BY share""")
def learning_curve_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    parts = [R.prefix_sample(e, "event_id", s, 4).agg(F.lit(s).alias("share"), F.count("*").alias("n"), F.sum("event_id").alias("keys")) for s in (0.1, 0.2, 0.4, 0.8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# One fold of twelve has no number and another is outside 0..9.
@query("fold_cover_report", """WITH f AS (SELECT user_id, CASE WHEN event_id % 12 < 11 THEN event_id % 12 END AS fold FROM events)
SELECT count(*) AS rows, count(DISTINCT user_id) AS keys, count(*) FILTER (fold IS NULL OR fold NOT BETWEEN 0 AND 9) AS outside FROM f""")
def fold_cover_report(spark, sf_dir):
    at = F.col("event_id") % 12
    return R.cover_report(table(spark, sf_dir, "events").select("user_id", F.when(at < 11, at).alias("fold")), "user_id", "fold", 10)
