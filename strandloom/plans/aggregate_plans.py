"""Aggregation and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import aggregates as A
from strandloom.operators.profiles import explode_profile
from strandloom.operators.ordering import exact_quantiles
from strandloom.plans.registry import query
from strandloom.sources.tables import table


def r6(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query("two_level_spread", """WITH f AS (SELECT user_id % 5 AS seed, event_id % 5 AS fold, avg(value) AS m FROM events GROUP BY ALL),
s AS (SELECT seed, avg(m) AS mean, stddev_pop(m) AS sd FROM f GROUP BY seed)
SELECT CAST(seed AS VARCHAR) AS level, round(mean, 6) AS mean, round(sd, 6) AS sd, NULL::DOUBLE AS sd_sample FROM s
UNION ALL SELECT 'all', round(avg(mean), 6), round(stddev_pop(mean), 6), round(stddev_samp(mean), 6) FROM s""")
def two_level_spread(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("seed"), (F.col("event_id") % 5).alias("fold"), "value")
    return r6(A.two_level_spread(e, "seed", "fold", "value"), "level")


@query("feature_frequency", "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, l_partkey LIMIT 50")
def feature_frequency(spark, sf_dir):
    return A.frequency(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey").orderBy(F.desc("count"), "l_partkey").limit(50)


@query("named_multi_agg", """SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS median,
  min(o_totalprice) AS lo, max(o_totalprice) AS hi, arg_min(o_totalprice, o_orderkey) AS first, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1""")
def named_multi_agg(spark, sf_dir):
    p = "o_totalprice"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("sd"), F.round(F.median(p), 4).alias("median"),
        F.min(p).alias("lo"), F.max(p).alias("hi"), F.min_by(p, "o_orderkey").alias("first"), F.count_distinct("o_custkey").alias("customers"),
    )


@query("dedup_mean", """SELECT md5(text) AS digest, round(avg(n_chars), 6) AS n_chars, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY md5(text)""")
def dedup_mean(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")
    return r6(A.mean_of_duplicates(d, "digest", "n_chars", "doc_id", ["lang", "source"]), "digest")


@query("dedup_first", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def dedup_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return A.keep_first(d, ["digest"], ["doc_id"])


@query("value_counts_null", "SELECT quality, toxic, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def value_counts_null(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("quality", "toxic").count()


@query("quantile_share", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.9), 4) AS q90,
  round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders GROUP BY 1""")
def quantile_share(spark, sf_dir):
    p = "o_totalprice"
    o = table(spark, sf_dir, "orders").select("o_orderpriority", p)
    out = o.groupBy("o_orderpriority").agg(F.round(F.avg((F.col(p) > 200000).cast("double")), 6).alias("share"))
    out = out.join(exact_quantiles(o, p, [0.5, 0.9], ["o_orderpriority"]), "o_orderpriority")
    return out.select("o_orderpriority", F.round(F.col("quantiles")[0], 4).alias("q50"), F.round(F.col("quantiles")[1], 4).alias("q90"), "share")


@query("conditional_counts", """WITH r AS (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events)
SELECT event_type, count(*) FILTER (r <= 10) AS top10, count(*) FILTER (r <= 20) AS top20, count(*) FILTER (r <= 50) AS top50 FROM r GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    from pyspark.sql import Window

    r = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value")))
    e = table(spark, sf_dir, "events").select("event_type", r.alias("r"))
    return e.groupBy("event_type").agg(*[F.count_if(F.col("r") <= k).alias(f"top{k}") for k in (10, 20, 50)])


@query("pivot_gain", """WITH w AS (SELECT user_id % 25 AS seed, avg(value) FILTER (event_type = 'click') AS click, avg(value) FILTER (event_type = 'view') AS view, avg(value) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1)
SELECT seed, round(click, 6) AS click, round(view, 6) AS view, round(purchase, 6) AS purchase, round(view - click, 6) AS view_gain, round(purchase - click, 6) AS purchase_gain FROM w""")
def pivot_gain(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("seed"), "event_type", "value")
    return r6(A.pivot_gain(e, "seed", "event_type", ["click", "view", "purchase"], "value", "click"), "seed")


@query("within_group_variance_share", """WITH g AS (SELECT c_acctbal AS v, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS m, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT count(*) AS n, round(var_samp(v - m) / var_samp(v), 6) AS share FROM g WHERE n >= 5""")
def within_group_variance_share(spark, sf_dir):
    return r6(A.within_group_variance_share(table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal"), "c_nationkey", "c_acctbal", 5))


@query("best_row_per_group", """SELECT o_custkey, o_totalprice, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def best_row_per_group(spark, sf_dir):
    return A.best_row(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", ["o_orderstatus"])


@query("spearman_by_group", """WITH s AS (SELECT c_custkey, c_nationkey, c_acctbal AS x, sum(o_totalprice) AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY x) + (count(*) OVER (PARTITION BY c_nationkey, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY c_nationkey ORDER BY y) + (count(*) OVER (PARTITION BY c_nationkey, y) - 1) / 2.0::DOUBLE AS ry FROM s)
SELECT c_nationkey, count(*) AS n, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 10""")
def spearman_by_group(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("x"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("y"))
    return r6(A.spearman_by(c.join(o, "c_custkey"), ["c_nationkey"], "x", "y", 10), "c_nationkey")


PRED = "l_quantity * 900 * (1 - l_discount)"


@query("r2_mse_by_fold", f"""WITH p AS (SELECT l_orderkey % 5 AS fold, l_extendedprice AS y, {PRED} AS p FROM lineitem)
SELECT fold, count(*) AS n, round(avg((y - p) * (y - p)), 2) AS mse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM p GROUP BY fold""")
def r2_mse_by_fold(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("fold"), F.col("l_extendedprice").alias("y"), F.expr(PRED).alias("p"))
    return A.fit_quality(li, ["fold"], "y", "p").select("fold", "n", F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"))


# The p-value in SQL by the finite series of the t distribution with a whole number of degrees of freedom.
@query("paired_t", """WITH d AS (SELECT event_type, user_id % 20 AS k, avg(value) FILTER (event_id % 2 = 0) - avg(value) FILTER (event_id % 2 = 1) AS d FROM events GROUP BY ALL),
t AS (SELECT event_type, count(*) AS n, avg(d) AS mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d WHERE d IS NOT NULL GROUP BY 1),
c AS (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS a FROM t),
e AS (SELECT *, list_sum(list_transform(range(0, CAST(v // 2 AS BIGINT)), lambda i: CASE WHEN v % 2 = 0
    THEN list_aggregate(list_prepend(1.0::DOUBLE, list_transform(range(1, i + 1), lambda j: (2 * j - 1) / (2.0::DOUBLE * j))), 'product') * power(cos(a), 2 * i)
    ELSE list_aggregate(list_prepend(1.0::DOUBLE, list_transform(range(1, i + 1), lambda j: (2 * j) / (2.0::DOUBLE * j + 1))), 'product') * power(cos(a), 2 * i + 1) END)) AS s FROM c)
SELECT event_type, n, round(mean, 6) AS mean, round(t, 5) AS t, round(1 - CASE WHEN v % 2 = 0 THEN sin(a) * s ELSE 2 / pi() * (a + sin(a) * s) END, 9) AS p FROM e""")
def paired_t(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    d = table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 20).alias("k")).agg((F.avg(F.when(even, F.col("value"))) - F.avg(F.when(~even, F.col("value")))).alias("d"))
    return A.paired_t(d.where("d IS NOT NULL"), ["event_type"], "d").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"), F.round("p", 9).alias("p"))


@query("concentration", """WITH s AS (SELECT p_partkey, p_retailprice AS w, sum(p_retailprice) OVER () AS a, count(*) OVER () AS n, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r,
  sum(p_retailprice) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) AS c FROM part)
SELECT round(1 / sum((w / a) * (w / a)), 4) AS effective, round(sum((2 * (n - r + 1) - n - 1) * w) / (max(n) * sum(w)), 6) AS gini,
  min(CASE WHEN c >= 0.5 * a THEN r END) AS n_50, min(CASE WHEN c >= 0.9 * a THEN r END) AS n_90 FROM s""")
def concentration(spark, sf_dir):
    out = A.concentration(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice")
    return out.withColumn("effective", F.round("effective", 4)).withColumn("gini", F.round("gini", 6))


@query("kuncheva_pairs", """WITH t AS (SELECT vec_id % 5 AS fold, CAST(i AS INTEGER) AS pos, avg(embedding[i]::DOUBLE * embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) t(i) GROUP BY ALL),
k AS (SELECT fold, pos FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY s DESC, pos) AS n FROM t) WHERE n <= 10)
SELECT a.fold, b.fold AS other, round((count(*) FILTER (a.pos = b.pos) - 100 / 64.0) / (10 - 100 / 64.0), 6) AS "index" FROM k a JOIN k b ON a.fold < b.fold GROUP BY a.fold, b.fold""")
def kuncheva_pairs(spark, sf_dir):
    from strandloom.operators.ordering import top_k

    e = explode_profile(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    s = e.groupBy((F.col("id") % 5).alias("fold"), "pos").agg(F.avg(F.col("v") * F.col("v")).alias("s"))
    return r6(A.kuncheva(top_k(s, ["fold"], [F.desc("s"), F.asc("pos")], 10).select("fold", "pos"), "fold", "pos", 64), "fold", "other")


@query("top_decile_precision", """WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ry, row_number() OVER (ORDER BY o_custkey % 97 * 1000 + o_totalprice / 1000 DESC, o_orderkey) AS rp, count(*) OVER () AS n FROM orders)
SELECT round(count(*) FILTER (ry <= n // 10 AND rp <= n // 10) / max(n // 10), 9) AS precision FROM r""")
def top_decile_precision(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 97 * 1000 + F.col("o_totalprice") / 1000).alias("p"))
    return A.top_share_precision(o, "y", "p", "o_orderkey", 0.1).select(F.round("precision", 9).alias("precision"))


@query("pick_percentile_closed_form", """WITH s AS (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2.0::DOUBLE AS ry,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey * 7919) % 1009, c_custkey) AS j, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, round(sum((power(j / n, 10) - power((j - 1) / n, 10)) * ry / n), 6) AS percentile FROM s GROUP BY 1""")
def pick_percentile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", (F.col("c_custkey") * 7919 % 1009).alias("p"))
    return r6(A.pick_percentile(c, ["c_nationkey"], "c_acctbal", "p", "c_custkey", 10), "c_nationkey")


@query("calibration_slope", f"""SELECT l_returnflag, round(regr_slope(l_extendedprice, {PRED}), 6) AS slope, round(regr_intercept(l_extendedprice, {PRED}), 3) AS intercept FROM lineitem GROUP BY 1""")
def calibration_slope(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), F.expr(PRED).alias("p"))
    return A.calibration(li, ["l_returnflag"], "y", "p").select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("fd_violations", """SELECT p_type, min(p_brand) AS value, count(DISTINCT p_brand) AS "values", count(DISTINCT p_brand) > 1 AS conflict FROM part GROUP BY 1""")
def fd_violations(spark, sf_dir):
    return A.dependency_conflicts(table(spark, sf_dir, "part").select("p_type", "p_brand"), ["p_type"], "p_brand")


@query("kmer_coverage", """WITH k AS (SELECT 'one' AS unit, substr(upper(p_name), i, 1) AS k FROM part, LATERAL (SELECT unnest(range(1, length(p_name) + 1)) AS i) UNION ALL
SELECT 'two', substr(upper(p_name), i, 2) FROM part, LATERAL (SELECT unnest(range(1, length(p_name))) AS i))
SELECT unit, count(DISTINCT k) AS seen, round(count(DISTINCT k) / CASE unit WHEN 'one' THEN 26 ELSE 676 END, 9) AS share FROM k GROUP BY unit""")
def kmer_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.upper("p_name").alias("s"))
    kmers = lambda k: F.transform(F.sequence(F.lit(1), F.length("s") - k + 1), lambda i: F.struct(F.lit({1: "one", 2: "two"}[k]).alias("unit"), F.substr("s", i, F.lit(k)).alias("k")))
    rows = p.select(F.inline(F.concat(kmers(1), kmers(2))))
    return A.coverage(rows, "unit", "k", {"one": 26, "two": 676}).select("unit", "seen", F.round("share", 9).alias("share"))


@query("noise_verdict", """WITH s AS (SELECT event_type, avg(value) - (SELECT avg(value) FROM events) AS effect, stddev_samp(value) / sqrt(count(*)) AS floor FROM events GROUP BY 1)
SELECT event_type, round(abs(effect) / nullif(floor, 0), 5) AS ratio, CASE WHEN abs(effect) / nullif(floor, 0) < 1.5 THEN 'noise' WHEN abs(effect) / nullif(floor, 0) < 5 THEN 'weak' ELSE 'clear' END AS verdict FROM s""")
def noise_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = e.agg(F.avg("value").alias("m"))
    s = e.groupBy("event_type").agg(F.avg("value").alias("v"), (F.stddev_samp("value") / F.sqrt(F.count("*").cast("double"))).alias("floor")).join(F.broadcast(mean))  # one row
    return A.noise_verdict(s.withColumn("effect", F.col("v") - F.col("m")), "effect", "floor").select("event_type", F.round("ratio", 5).alias("ratio"), "verdict")


@query("reliability_ceiling", "SELECT p_partkey, round(sqrt(2 * (p_size / 51.0) / (1 + p_size / 51.0)), 9) AS ceiling FROM part")
def reliability_ceiling(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(A.reliability(F.col("p_size") / F.lit(51.0)), 9).alias("ceiling"))


@query("quadratic_turning_point", """WITH m AS (SELECT l_returnflag, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
c AS (SELECT l_returnflag, mx, l_quantity - mx AS u, l_extendedprice - my AS v FROM lineitem JOIN m USING (l_returnflag)),
s AS (SELECT l_returnflag, mx, count(*) AS n, avg(u*u) AS s2, avg(u*u*u) AS s3, avg(u*u*u*u) AS s4, avg(u*v) AS t1, avg(u*u*v) AS t2, avg(v*v) AS vv FROM c GROUP BY ALL),
f AS (SELECT *, (t1 * (s4 - s2*s2) - s3*t2) / (s2 * (s4 - s2*s2) - s3*s3) AS b1, (s2*t2 - s3*t1) / (s2 * (s4 - s2*s2) - s3*s3) AS c1 FROM s)
SELECT l_returnflag, n, round(c1, 5) AS c, round(b1 - 2*c1*mx, 4) AS b, round((b1*t1 + c1*t2) / vv, 6) AS r2 FROM f""")
def quadratic_turning_point(spark, sf_dir):
    out = A.quadratic_fit(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("c", 5).alias("c"), F.round("b", 4).alias("b"), F.round("r2", 6).alias("r2"))


@query("category_share", """WITH l AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD', 'NOTHING']) AS c_mktsegment), s AS (SELECT c_mktsegment, sum(c_acctbal) AS w FROM customer GROUP BY 1)
SELECT c_mktsegment, round(coalesce(w, 0), 2) AS w, round(coalesce(w, 0) / (SELECT sum(w) FROM s JOIN l USING (c_mktsegment)), 6) AS share FROM l LEFT JOIN s USING (c_mktsegment)""")
def category_share(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD", "NOTHING")], "c_mktsegment string")
    out = A.share_by_category(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal", labels)
    return out.select("c_mktsegment", F.round("w", 2).alias("w"), F.round("share", 6).alias("share"))


@query("describe_by_group", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS lo, round(quantile_cont(value, 0.25), 6) AS q1,
  round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS hi FROM events GROUP BY 1""")
def describe_by_group(spark, sf_dir):
    return r6(A.describe(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value"), "event_type")


@query("gram_matrix", """WITH t AS (SELECT vec_id, vec_id % 5 AS fold, CAST(i AS INTEGER) AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i))
SELECT a.fold, a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 6) AS s FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY ALL""")
def gram_matrix(spark, sf_dir):
    e = explode_profile(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding").withColumn("fold", F.col("id") % 5)
    return r6(A.gram(e, "fold", "id", "pos", "v"), "fold", "i", "j")


BOOT = """WITH g AS (SELECT c_nationkey AS g, row_number() OVER (ORDER BY c_nationkey) - 1 AS slot FROM (SELECT DISTINCT c_nationkey FROM customer)),
d0 AS (SELECT r AS replicate, CAST('0x' || substr(md5(r || ':' || slot), 1, 8) AS BIGINT) % (SELECT count(*) FROM g) AS slot FROM g, range(0, 40) t(r)), d AS (SELECT {distinct} replicate, slot FROM d0),
s AS (SELECT c_nationkey, sum(c_acctbal) AS s, count(*) AS c FROM customer GROUP BY 1)
SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(s) / sum(c), 5) AS mean FROM d JOIN g USING (slot) JOIN s ON c_nationkey = g GROUP BY 1"""


def _bootstrap(spark, sf_dir, bag):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal")
    # A nation a row: the window's single task reads few rows at any scale.
    g = c.select(F.col("c_nationkey").alias("g")).distinct().withColumn("slot", (F.row_number().over(Window.orderBy("g")) - 1).cast("long"))
    return A.group_bootstrap(c, g, "c_nationkey", "c_acctbal", 40, bag).select("replicate", F.round("mean", 5).alias("mean"))


@query("group_bootstrap_bag", BOOT.format(distinct=""))
def group_bootstrap_bag(spark, sf_dir):
    return _bootstrap(spark, sf_dir, True)


@query("group_bootstrap_mask", BOOT.format(distinct="DISTINCT"))
def group_bootstrap_mask(spark, sf_dir):
    return _bootstrap(spark, sf_dir, False)


@query("cube_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
