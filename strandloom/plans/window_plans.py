"""Window, order and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import ordering as W
from strandloom.plans.registry import query
from strandloom.sources.tables import table


# Every seventh order has no date: NULL has no rank and counts for none.
@query("average_rank", """SELECT o_orderkey, CASE WHEN d IS NOT NULL THEN rank() OVER (ORDER BY d NULLS LAST) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE END AS rank,
  round(CASE WHEN d IS NOT NULL THEN (rank() OVER (ORDER BY d NULLS LAST) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE) / count(d) OVER () END, 9) AS pct
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN epoch(o_orderdate)::BIGINT END AS d FROM orders)""")
def average_rank(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 7 > 0, F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", date.alias("d"))
    n = o.agg(F.count("d").alias("n"))
    return W.average_rank(o, "d", "rank").join(F.broadcast(n)).select("o_orderkey", "rank", F.round(F.col("rank") / F.col("n"), 9).alias("pct"))  # one row


@query("clipped_window_mean", """SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING), 6) AS mean FROM events""")
def clipped_window_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return W.clipped_mean(e, "event_id", "value", 50, 49, "mean").select("event_id", F.round("mean", 6).alias("mean"))


@query("circular_window_mean", """WITH n AS (SELECT max(event_id) + 1 AS n FROM events), r AS (SELECT event_id + 1 + k * n AS p, value, k FROM events, n, (VALUES (-1), (0), (1)) v(k)),
m AS (SELECT p, k, avg(value) OVER (ORDER BY p ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING) AS mean FROM r) SELECT p AS pos, round(mean, 6) AS mean FROM m WHERE k = 0""")
def circular_window_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("pos"), "value")
    n = e.agg(F.max("pos")).first()[0]
    return W.circular_mean(e, "pos", "value", 50, 49, n, "mean").select("pos", F.round("mean", 6).alias("mean"))


@query("cumulative_extrema", """WITH c AS (SELECT event_id, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum FROM events)
SELECT (SELECT event_id FROM c ORDER BY cum, event_id LIMIT 1) AS argmin, (SELECT event_id FROM c ORDER BY cum DESC, event_id LIMIT 1) AS argmax""")
def cumulative_extrema(spark, sf_dir):
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    return W.running_extremes(table(spark, sf_dir, "events").select("event_id", step.alias("step")), "event_id", "step")


@query("quantile_bands", """WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS c FROM orders)
SELECT o_orderkey, CAST(len(list_filter(c, lambda x: x <= o_totalprice)) AS INTEGER) AS band FROM orders, q""")
def quantile_bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return W.quantile_bands(o, "o_totalprice", 5, "band").select("o_orderkey", "band")


@query("running_best", """WITH b AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events),
c AS (SELECT *, CASE WHEN best > coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY event_id), -1e300) THEN event_id END AS rose FROM b)
SELECT user_id, event_id, best, event_id - max(rose) OVER (PARTITION BY user_id ORDER BY event_id) AS since FROM c""")
def running_best(spark, sf_dir):
    return W.running_best(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "best", "since")


@query("longest_run", """WITH c AS (SELECT p_partkey, length(p_name) AS n, i, substr(p_name, i, 1) AS ch FROM part, LATERAL (SELECT unnest(range(1, length(p_name) + 1)) AS i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, ch ORDER BY i) AS g FROM c), r AS (SELECT p_partkey, n, count(*) AS k FROM g GROUP BY p_partkey, n, ch, g)
SELECT p_partkey, max(k) AS longest, round(max(k) / n, 9) AS share FROM r GROUP BY p_partkey, n""")
def longest_run(spark, sf_dir):
    return W.longest_run(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name").withColumn("share", F.round("share", 9))


@query("topk_per_group", """SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def topk_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return W.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("global_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.orderBy(F.md5(F.concat(F.lit("7:"), "o_orderkey")), "o_orderkey").limit(100)


@query("insulation_index", """WITH b AS (SELECT event_id // 100 AS bin, sum(value) AS v FROM events GROUP BY 1), n AS (SELECT max(bin) + 1 AS n FROM b),
s AS (SELECT (((bin - d) % n) + n) % n AS bin, d, v FROM b, n, range(-10, 11) t(d) WHERE d <> 0),
g AS (SELECT bin, coalesce(sum(v) FILTER (d > 0), 0) AS r, coalesce(sum(v) FILTER (d < 0), 0) AS l FROM s GROUP BY bin)
SELECT bin, round(coalesce((r - l) / nullif(r + l, 0), 0), 6) AS insulation FROM g""")
def insulation_index(spark, sf_dir):
    b = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 100).alias("bin")).agg(F.sum("value").alias("v"))
    n = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 100) + 1).first()[0]
    return W.insulation(b, "bin", "v", n, 10).withColumn("insulation", F.round("insulation", 6))


@query("smooth_local_split", """SELECT event_id, round(avg(value) OVER (PARTITION BY event_id // 250), 6) AS smooth, round(value - avg(value) OVER (PARTITION BY event_id // 250), 6) AS local FROM events""")
def smooth_local_split(spark, sf_dir):
    from pyspark.sql import Window

    smooth = F.avg("value").over(Window.partitionBy(F.floor(F.col("event_id") / 250)))
    return table(spark, sf_dir, "events").select("event_id", F.round(smooth, 6).alias("smooth"), F.round(F.col("value") - smooth, 6).alias("local"))


@query("union_intersect_except", """SELECT 'both' AS part, c_nationkey AS k FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 8000 INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers', c_nationkey FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 8000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)
UNION ALL SELECT 'any', c_nationkey FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
UNION ALL SELECT 'all', c_nationkey FROM (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 9900)""")
def union_intersect_except(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("b"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("b"))

    def keys(df, least):
        return df.where(F.col("b") > least).select("k")

    parts = {
        "both": keys(c, 8000).intersect(s.select("k")), "customers": keys(c, 8000).subtract(keys(s, 0)),
        "any": keys(c, 9000).union(keys(s, 9000)).distinct(), "all": keys(c, 9900).unionByName(keys(s, 9900)),
    }
    out = [df.select(F.lit(name).alias("part"), "k") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
