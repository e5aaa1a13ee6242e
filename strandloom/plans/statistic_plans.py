"""Queries of bootstrap intervals, roll-ups, decodings and interactions."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import aggregates as A, bootstrap as B, cleaning as C
from strandloom.plans.aggregate_plans import r6
from strandloom.plans.registry import query
from strandloom.plans.sequence_plans import D, dna
from strandloom.sources.tables import table

# Steps of the Poisson(1) distribution; DuckDB and Spark draw the same number from the same md5.
_DRAW = "CAST('0x' || substr(md5(rep || ':' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_STEPS = " + ".join(f"CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in itertools.accumulate(math.exp(-1) / math.factorial(i) for i in range(12)))


@query("row_bootstrap_interval", f"""WITH e AS (SELECT event_id, value AS y, value * 0.5 + event_id % 7 AS p FROM events), r AS (SELECT rep, event_id, y, p, {_DRAW} AS u FROM e, range(-1, 60) t(rep)),
w AS (SELECT rep, y, p, CASE WHEN rep < 0 THEN 1.0::DOUBLE ELSE ({_STEPS})::DOUBLE END AS w FROM r),
m AS (SELECT rep, sum(w * (y - p) * (y - p)) / sum(w) AS mse, sum(w * y) / sum(w) AS mean_y FROM w GROUP BY rep),
t AS (SELECT 'mse' AS metric, rep, mse AS v FROM m UNION ALL SELECT 'mean_y', rep, mean_y FROM m)
SELECT metric, round(max(v) FILTER (rep < 0), 5) AS point, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 5) AS lo, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 5) AS hi, round(stddev_samp(v) FILTER (rep >= 0), 5) AS se FROM t GROUP BY metric""")
def row_bootstrap_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("y"), (F.col("value") * 0.5 + F.col("event_id") % 7).alias("p"))
    w, error = F.col("w"), F.col("y") - F.col("p")
    metrics = {"mse": F.sum(w * error * error) / F.sum(w), "mean_y": F.sum(w * F.col("y")) / F.sum(w)}
    out = A.row_bootstrap(e, "event_id", metrics, 60)
    return out.select("metric", *[F.round(c, 5).alias(c) for c in ("point", "lo", "hi", "se")])


@query("quality_counts", """SELECT count(*) AS rows, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_totalprice > 200000) AS dear, count(*) FILTER (nullif(o_orderpriority, '1-URGENT') IS NULL) AS urgent FROM orders""")
def quality_counts(spark, sf_dir):
    checks = {"open": F.col("o_orderstatus") == "O", "dear": F.col("o_totalprice") > 200000, "urgent": F.nullif("o_orderpriority", F.lit("1-URGENT")).isNull()}
    return A.quality_counts(table(spark, sf_dir, "orders"), checks)


@query("direction_summary", """WITH c AS (SELECT event_type AS name, value AS v, round((event_id % 11) * value / 10 - value * value / 100, 6) AS c FROM events)
SELECT name, count(c) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS q0, round(quantile_cont(c, 0.25), 6) AS q25, round(quantile_cont(c, 0.5), 6) AS q50, round(quantile_cont(c, 0.75), 6) AS q75, round(max(c), 6) AS q100,
  round(coalesce(covar_pop(v, c) / nullif(stddev_pop(v) * stddev_pop(c), 0), 0), 6) AS direction FROM c GROUP BY name""")
def direction_summary(spark, sf_dir):
    v = F.col("value")
    c = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), v.alias("v"), F.round((F.col("event_id") % 11) * v / 10 - v * v / 100, 6).alias("c"))
    return r6(A.direction_summary(c, "name", "v", "c"), "name", "n")


@query("group_rank_summary", """WITH e AS (SELECT user_id, value, event_id * 17 % 101 AS x FROM events), r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY user_id ORDER BY x) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2.0::DOUBLE AS b FROM e),
g AS (SELECT user_id, coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0) AS rho FROM r GROUP BY user_id HAVING count(*) >= 5)
SELECT count(*) AS groups, round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS sd, round(median(rho), 6) AS median FROM g""")
def group_rank_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "value", (F.col("event_id") * 17 % 101).alias("x"))
    return r6(A.group_rank_summary(e, "user_id", "value", "x", 5), "groups")


@query("decode_codes", f"""{D} SELECT p_partkey, regexp_replace(s, '[^ACGT]', 'N', 'g') AS decoded, CAST(0 AS BIGINT) + (SELECT count(*) FROM d WHERE regexp_matches(s, '[^ACGT]')) AS unknown FROM d""")
def decode_codes(spark, sf_dir):
    # The numeric codes of the four letters.
    codes = {"42": "C", "48": "T", "50": "A", "56": "G"}
    back = F.create_map(*[F.lit(x) for k, v in codes.items() for x in (v, k)])
    coded = dna(spark, sf_dir).select("p_partkey", F.transform(F.split("s", ""), lambda c: F.try_element_at(back, c)).alias("x"))
    unknown = S.unknown_codes(coded.select(F.explode("x").alias("code")), "code", codes).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("unknown"))
    return coded.select("p_partkey", S.decode(F.col("x"), codes).alias("decoded")).join(F.broadcast(unknown))  # one row


@query("sequence_predicates", f"""{D}, o AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN s[:4] || 'N' || s[5:] ELSE s END AS s FROM d)
SELECT p_partkey, regexp_full_match(s, '[ACGT]+') AS valid, regexp_full_match(s, '[ACGT]{{20}}') AS valid20, contains(s, 'N') AS unknown FROM o""")
def sequence_predicates(spark, sf_dir):
    s = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.substring("s", 1, 4), F.lit("N"), F.substr("s", F.lit(5)))).otherwise(F.col("s"))
    return dna(spark, sf_dir).select("p_partkey", S.is_sequence(s).alias("valid"), S.is_sequence(s, 20).alias("valid20"), S.has_unknown(s).alias("unknown"))


@query("interaction_terms", """WITH m AS (SELECT avg(o_totalprice) AS m FROM orders) SELECT o_orderkey, round((o_totalprice - m) * (CAST(o_orderstatus = 'O' AS DOUBLE) - 0.5), 4) AS term FROM orders, m""")
def interaction_terms(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "O").cast("double").alias("open"))
    out = A.interaction(o, "o_totalprice", "open", "term", centre=0.5)
    return out.select("o_orderkey", F.round("term", 4).alias("term"))


@query("drop_present_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def drop_present_columns(spark, sf_dir):
    return C.drop_present(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderdate", "not there"])


@query("wide_gram_matrix", """WITH t AS (SELECT event_id AS id, event_id % 3 AS fold, CAST(event_id * k % 1000 AS INTEGER) AS pos, value / (k + 0.7::DOUBLE) AS v FROM events, range(1, 5) r(k)), u AS (SELECT id, fold, pos, max(v) AS v FROM t GROUP BY ALL)
SELECT a.fold, a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 5) AS s FROM u a JOIN u b ON a.id = b.id AND a.pos <= b.pos GROUP BY ALL""")
def wide_gram_matrix(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value", F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("k"))
    pos = (F.col("event_id") * F.col("k") % 1000).cast("int")
    t = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3).alias("fold"), pos.alias("pos"), (F.col("value") / (F.col("k") + 0.7)).alias("v"))
    sums = A.gram(t.groupBy("id", "fold", "pos").agg(F.max("v").alias("v")), "fold", "id", "pos", "v")
    return sums.withColumn("s", F.round("s", 5))


@query("bootstrap_n_of_n")
def bootstrap_n_of_n(spark, sf_dir):
    """Intervals over replicates of exactly n of n rows; the tests compare the draws with their distribution."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("y"), (F.col("value") * 0.5 + F.col("event_id") % 7).alias("p"))
    w, error = F.col("w"), F.col("y") - F.col("p")
    metrics = {"mse": F.sum(w * error * error) / F.sum(w), "mean_y": F.sum(w * F.col("y")) / F.sum(w)}
    return B.bootstrap_interval(e, "event_id", metrics, 60)


@query("bootstrap_weights", """SELECT CAST(r AS INTEGER) AS replicate, (SELECT count(*) FROM orders) AS n, CASE WHEN r < 0 THEN round((SELECT avg(o_totalprice) FROM orders), 4) END AS mean
FROM range(-1, 20) t(r)""")
def bootstrap_weights(spark, sf_dir):
    """Every replicate's weights sum to the rows' number; its point is the plain mean."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out = B.bootstrap_replicates(o, "o_orderkey", {"mean": F.sum(F.col("w") * F.col("o_totalprice")) / F.sum("w")}, 20)
    return out.select("replicate", F.col("n").cast("long").alias("n"), F.when(F.col("replicate") < 0, F.round("mean", 4)).alias("mean"))


@query("turning_point_interval")
def turning_point_interval(spark, sf_dir):
    """Turning point of price on quantity with its bootstrap interval."""
    l = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))  # noqa: E741
    return B.bootstrap_interval(l, "key", {"turning_point": B.turning_point("x", "y")}, 20)
