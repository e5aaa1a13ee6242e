"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import cleaning as C
from strandloom.plans.registry import query
from strandloom.sources.tables import table


@query("coerce_numeric", """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS kind FROM events""")
def coerce_numeric(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"))
    return C.coerce_numeric(e, ["k", "kind"])


@query("id_parse", """SELECT p_partkey, lower(regexp_extract(p_brand, '^(.*?)#(\\d+)$', 1)) AS word, CAST(regexp_extract(p_brand, '^(.*?)#(\\d+)$', 2) AS BIGINT) AS number,
  coalesce(regexp_matches('g' || p_partkey || 'B' || (1000 + p_size) || '_' || p_size || '_' || p_brand, '^(.*?)([bB]\\d+)_(\\d+)_(.+)$'), false) AS parsed,
  'b' || (1000 + p_size) AS locus FROM part""".replace("\\\\", "\\"))
def id_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    made = F.concat(F.lit("g"), F.col("p_partkey"), F.lit("B"), F.col("p_size") + 1000, F.lit("_"), F.col("p_size"), F.lit("_"), F.col("p_brand"))
    parsed = C.parse_identifier(made)
    brand = r"^(.*?)#(\d+)$"
    return p.select(
        "p_partkey", F.lower(F.regexp_extract("p_brand", brand, 1)).alias("word"), F.regexp_extract("p_brand", brand, 2).cast("long").alias("number"),
        parsed.isNotNull().alias("parsed"), parsed["locus"].alias("locus"),
    )


LADDER = [("^[A-C]", "early"), ("a", "has_a"), ("^.{0,12}$", "short")]


@query("category_case", """SELECT c_custkey, CASE WHEN regexp_matches(c_mktsegment, '^[A-C]') THEN 'early' WHEN regexp_matches(c_mktsegment, 'a') THEN 'has_a'
  WHEN regexp_matches(c_mktsegment, '^.{0,12}$') THEN 'short' ELSE 'other' END AS category FROM customer""")
def category_case(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.first_match(F.col("c_mktsegment"), LADDER, "other").alias("category"))


@query("mode_length_filter", """WITH m AS (SELECT length(p_name) AS n, count(*) AS c FROM part GROUP BY 1 ORDER BY c DESC, n LIMIT 1)
SELECT p_partkey, p_name FROM part JOIN m ON length(p_name) = n""")
def mode_length_filter(spark, sf_dir):
    return C.modal_length(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")


@query("quantile_filter", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)""")
def quantile_filter(spark, sf_dir):
    return C.above_quantile(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.9)


@query("stratum_gate", """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 60)""")
def stratum_gate(spark, sf_dir):
    return C.large_strata(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 60)


KINDS = ["click", "view", "purchase", "signup", "error"]


@query("one_hot", """SELECT event_id, CAST(coalesce(t = 'click', false) AS INTEGER) AS is_click, CAST(coalesce(t = 'view', false) AS INTEGER) AS is_view,
  CAST(coalesce(t = 'purchase', false) AS INTEGER) AS is_purchase, CAST(coalesce(t = 'signup', false) AS INTEGER) AS is_signup, CAST(coalesce(t = 'error', false) AS INTEGER) AS is_error
  FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS t FROM events)""")
def one_hot(spark, sf_dir):
    kind = F.when(F.col("event_id") % 7 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", *C.one_hot(kind, "is_", KINDS))


@query("recode_strip", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 END AS open, regexp_replace(o_orderpriority, '^\\d-', '') AS priority FROM orders""".replace("\\\\", "\\"))
def recode_strip(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", C.recode(F.col("o_orderstatus"), {"O": 1, "F": 0}).alias("open"), F.regexp_replace("o_orderpriority", r"^\d-", "").alias("priority")
    )


@query("clip_indicators", """SELECT o_orderkey, least(o_totalprice, 100000) AS capped, greatest(o_totalprice, 1000) AS floored, CAST(o_totalprice < 50000 AS INTEGER) AS low FROM orders""")
def clip_indicators(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.least(p, F.lit(100000.0)).alias("capped"), F.greatest(p, F.lit(1000.0)).alias("floored"), (p < 50000).cast("int").alias("low")
    )


@query("nonfinite_to_null", """SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN round(p_retailprice / (p_size % 5), 6) END AS ratio FROM part""")
def nonfinite_to_null(spark, sf_dir):
    made = F.when(F.col("p_size") % 5 == 0, F.when(F.col("p_size") % 2 == 0, float("inf")).otherwise(float("nan"))).otherwise(F.col("p_retailprice") / (F.col("p_size") % 5))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(C.nonfinite_to_null(made), 6).alias("ratio"))


@query("schema_fingerprint", """SELECT r_regionkey, sha256('["r_regionkey","r_name"]') AS digest FROM region""")
def schema_fingerprint(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select("r_regionkey", F.lit(C.schema_fingerprint(r.columns)).alias("digest"))


@query("offset_inference", """WITH s AS (SELECT o, avg(CASE WHEN substr(p_type, o + 1, 2) = 'AN' THEN 1.0 ELSE 0.0 END) AS share FROM part, range(0, 12) t(o) GROUP BY o)
SELECT CAST(o AS INTEGER) AS "offset", round(share, 9) AS share FROM s ORDER BY share DESC, o LIMIT 1""")
def offset_inference(spark, sf_dir):
    found = C.best_offset(table(spark, sf_dir, "part").select("p_type"), "p_type", "AN", range(12), 0.0)
    return found.select("offset", F.round("share", 9).alias("share"))


@query("fill_report", """SELECT 'quality' AS name, count(quality) AS filled, count(DISTINCT quality) AS "distinct" FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic', count(toxic), count(DISTINCT toxic) FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'lang', count(lang), count(DISTINCT lang) FROM documents""")
def fill_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return C.fill_report(d, ["quality", "toxic", "lang"])


@query("agreement_share", """WITH a AS (SELECT vec_id, i AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i))
SELECT count(*) AS cells, round(avg(CASE WHEN abs(x - round(x, 6)) <= 1e-6 + 1e-5 * abs(round(x, 6)) THEN 1.0 ELSE 0.0 END), 9) AS share FROM a""")
def agreement_share(spark, sf_dir):
    from strandloom.operators.profiles import explode_profile

    a = explode_profile(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return C.agreement(a, a.withColumn("v", F.round("v", 6)), ["id", "pos"], "v").withColumn("share", F.round("share", 9))


@query("reorder_to_list", """SELECT k AS n_nationkey, row_number() OVER (ORDER BY k DESC) AS ord, n_name FROM range(0, 31, 3) t(k) LEFT JOIN nation ON n_nationkey = k""")
def reorder_to_list(spark, sf_dir):
    order = spark.range(0, 31, 3).select(F.col("id").alias("n_nationkey"), (F.lit(11) - (F.col("id") / 3).cast("long")).alias("ord"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    return C.reorder(nation, "n_nationkey", order)
