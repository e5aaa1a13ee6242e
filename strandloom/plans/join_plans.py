"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import joins as J
from strandloom.operators.profiles import explode_profile
from strandloom.plans.registry import query
from strandloom.sources.tables import table


@query("block_left_join", """SELECT c_custkey, n_name, n_orders, spend FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spend FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def block_left_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return J.left_blocks(J.left_blocks(c, "n_nationkey", [n]), "c_custkey", [o]).select("c_custkey", "n_name", "n_orders", "spend")


@query("semi_anti_resume", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) AS member,
  NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS todo FROM customer""")
def semi_anti_resume(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    todo = J.remaining(c, o.where("o_orderstatus = 'F'"), ["c_custkey"])
    flagged = J.flag_members(c, "c_custkey", o.where("o_totalprice > 150000"))
    return J.flag_members(flagged.withColumnRenamed("member", "big"), "c_custkey", todo).select("c_custkey", F.col("big").alias("member"), F.col("member").alias("todo"))


@query("paired_delta", """WITH cube AS (SELECT user_id % 5 AS seed, event_id % 5 AS fold, event_type AS arm, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.seed, a.fold, a.arm, round(a.v - b.v, 6) AS delta FROM cube a JOIN cube b ON a.seed = b.seed AND a.fold = b.fold AND b.arm = 'click' WHERE a.arm <> 'click'""")
def paired_delta(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cube = e.groupBy((F.col("user_id") % 5).alias("seed"), (F.col("event_id") % 5).alias("fold"), F.col("event_type").alias("arm")).agg(F.avg("value").alias("v"))
    return J.paired_deltas(cube, ["seed", "fold"], "arm", "v", "click").withColumn("delta", F.round("delta", 6))


@query("screens_inner_join", """WITH s AS (SELECT l_partkey, l_returnflag, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT a.l_partkey, round(a.v, 6) AS a, round(r.v, 6) AS r, round(a.v - r.v, 6) AS gap FROM s a JOIN s r USING (l_partkey) WHERE a.l_returnflag = 'A' AND r.l_returnflag = 'R'""")
def screens_inner_join(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").groupBy("l_partkey").agg(
        F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice"))).alias("a"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))).alias("r")
    )  # one pass instead of a self-join
    return s.where("a IS NOT NULL AND r IS NOT NULL").select("l_partkey", F.round("a", 6).alias("a"), F.round("r", 6).alias("r"), F.round(F.col("a") - F.col("r"), 6).alias("gap"))


@query("interval_containment", """WITH iv AS (SELECT o_orderkey, o_custkey, epoch(o_orderdate) // 86400 AS low, epoch(o_orderdate) // 86400 + 3 + o_orderkey % 40 AS high FROM orders),
pt AS (SELECT e.event_id, e.event_id * 7 % 1500 + (SELECT min(epoch(o_orderdate)) // 86400 FROM orders) AS p, e.user_id AS o_custkey FROM events e),
f AS (SELECT event_id, p, o_orderkey, low, row_number() OVER (PARTITION BY event_id ORDER BY low DESC, o_orderkey) AS n FROM pt JOIN iv USING (o_custkey) WHERE p BETWEEN low AND high)
SELECT event_id, CAST(p AS BIGINT) AS p, o_orderkey, CAST(low AS BIGINT) AS low FROM f WHERE n = 1""")
def interval_containment(spark, sf_dir):
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day.alias("low")).withColumn("high", F.col("low") + 3 + F.col("o_orderkey") % 40)
    start = o.agg(F.min("low").alias("start"))
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("o_custkey")).join(F.broadcast(start)).withColumn("p", F.col("event_id") * 7 % 1500 + F.col("start"))  # one row
    found = J.interval_containment(e, o, "p", "low", "high", 16, ["o_custkey"])
    return J.first_containing(found, "event_id", "low", "o_orderkey").select("event_id", "p", "o_orderkey", "low")


@query("nearest_point_circular", """WITH q AS (SELECT event_id, event_id * 37 % 100003 AS p FROM events WHERE event_id % 3 <> 0),
t AS (SELECT DISTINCT event_id * 37 % 100003 AS p FROM events WHERE event_id % 3 = 0), r AS (SELECT p + k AS p FROM t, (VALUES (-100003), (0), (100003)) v(k))
SELECT event_id, q.p AS p, q.p - max(CASE WHEN r.p <= q.p THEN r.p END) AS before, min(CASE WHEN r.p >= q.p THEN r.p END) - q.p AS after FROM q, r GROUP BY event_id, q.p""")
def nearest_point_circular(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 100003).alias("p"))
    return J.nearest_on_line(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), "event_id", "p", circle=100003)


@query("hamming_burden", """WITH s AS (SELECT p_partkey, substr(rpad(p_name, 12, '_'), 1, 12) AS s FROM part), x AS (
SELECT a.p_partkey, hamming(a.s, b.s) AS m FROM s a JOIN s b ON a.p_partkey <> b.p_partkey WHERE a.p_partkey % 20 = 0 AND hamming(a.s, b.s) <= 4),
c AS (SELECT p_partkey, count(*) FILTER (m = 0) AS copies, count(*) FILTER (m = 1) AS mm1, count(*) FILTER (m = 2) AS mm2, count(*) FILTER (m = 3) AS mm3,
  count(*) FILTER (m = 4) AS mm4, CAST(min(m) FILTER (m > 0) AS BIGINT) AS least, round(sum(CASE WHEN m > 0 THEN power(4.0, -m) ELSE 0 END), 6) AS burden FROM x GROUP BY p_partkey)
SELECT p_partkey, coalesce(copies, 0) AS copies, coalesce(mm1, 0) AS mm1, coalesce(mm2, 0) AS mm2, coalesce(mm3, 0) AS mm3, coalesce(mm4, 0) AS mm4, least, coalesce(burden, 0) AS burden
FROM s LEFT JOIN c USING (p_partkey) WHERE p_partkey % 20 = 0""")
def hamming_burden(spark, sf_dir):
    s = table(spark, sf_dir, "part").select("p_partkey", F.substring(F.rpad("p_name", 12, "_"), 1, 12).alias("s"))
    q, m, n = s.where("p_partkey % 20 = 0"), F.col("mismatches"), F.col("n")
    counts = s.groupBy(F.col("s").alias("r")).agg(F.count("*").alias("n"))
    # A text's own copies, less the row itself, are its pairs without a mismatch; they are no burden and no nearest text.
    pairs = J.hamming_texts(q, s, "s", 12, 4).join(counts, "r").withColumn("n", n - (F.col("l") == F.col("r")).cast("long")).where("n > 0")
    of = lambda i: F.sum(F.when(m == i, n).otherwise(0))
    per_text = pairs.groupBy(F.col("l").alias("s")).agg(
        of(0).alias("copies"), *[of(i).alias(f"mm{i}") for i in range(1, 5)], F.min(F.when(m > 0, m)).cast("long").alias("least"),
        F.round(F.sum(F.when(m > 0, n * F.pow(F.lit(4.0), -m)).otherwise(0.0)), 6).alias("burden"),
    )
    return q.join(per_text, "s", "left").drop("s").na.fill(0, ["copies", "mm1", "mm2", "mm3", "mm4", "burden"])


@query("group_knn", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS o, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS n FROM d)
SELECT vec_id, round(avg(d) FILTER (n <= 5), 6) AS mean_near, count(*) FILTER (d <= 1.2) AS within FROM r GROUP BY vec_id""")
def group_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return J.neighbours(v, "vec_id", "e", 5, 1.2, "label").withColumn("mean_near", F.round("mean_near", 6))


@query("all_pairs_knn", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS o, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS n FROM d)
SELECT vec_id, round(avg(d) FILTER (n <= 5), 6) AS mean_near, count(*) FILTER (d <= 1.2) AS within FROM r GROUP BY vec_id""")
def all_pairs_knn(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return J.neighbours(v, "vec_id", "embedding", 5, 1.2).withColumn("mean_near", F.round("mean_near", 6))


INTERVALS = """WITH p AS (SELECT event_id, event_id * 37 % 9973 AS x FROM events), i AS (SELECT p_partkey AS n, p_partkey * 53 % 9973 AS l, p_partkey * 53 % 9973 + p_size % 7 AS h FROM part)"""


def _intervals(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 9973).alias("x"))
    l = F.col("p_partkey") * 53 % 9973  # noqa: E741
    return p, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), l.alias("l"), (l + F.col("p_size") % 7).alias("h"))


@query("nearest_interval", f"""{INTERVALS}, d AS (SELECT x, n, CASE WHEN x BETWEEN l AND h THEN 0 ELSE least(abs(x - l), abs(x - h)) END AS d FROM (SELECT DISTINCT x FROM p) q, i),
b AS (SELECT x, min({{'d': d, 'n': n}}) AS b FROM d GROUP BY x) SELECT event_id, CAST(b.d AS BIGINT) AS distance, b.n AS number FROM p JOIN b USING (x)""")
def nearest_interval(spark, sf_dir):
    p, i = _intervals(spark, sf_dir)
    return J.nearest_interval(p, i, "event_id", "x", "l", "h", "n")


@query("nearest_midpoint", f"""{INTERVALS}, d AS (SELECT x, n, abs(2 * x - l - h) / 2 AS d FROM (SELECT DISTINCT x FROM p) q, i),
b AS (SELECT x, min({{'d': d, 'n': n}}) AS b FROM d GROUP BY x) SELECT event_id, b.d AS distance, b.n AS number FROM p JOIN b USING (x)""")
def nearest_midpoint(spark, sf_dir):
    p, i = _intervals(spark, sf_dir)
    return J.nearest_midpoint(p, i, "event_id", "x", "l", "h", "n")


@query("bin_lookup", """WITH b AS (SELECT ((event_id - 1) // 50) % 40 AS bin, round(avg(value), 6) AS bin_mean FROM events WHERE event_id > 0 GROUP BY 1)
SELECT event_id, CAST(bin AS BIGINT) AS bin, bin_mean FROM (SELECT event_id, ((event_id - 1) // 50) % 40 AS bin FROM events WHERE event_id > 0) JOIN b USING (bin)""")
def bin_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id > 0").select("event_id", "value")
    bins = e.groupBy(F.pmod(F.floor((F.col("event_id") - 1) / 50), F.lit(40)).alias("bin")).agg(F.round(F.avg("value"), 6).alias("bin_mean"))
    return J.bin_lookup(e.select("event_id"), "event_id", 50, bins, 40).select("event_id", "bin", "bin_mean")


@query("fingerprint_match", """WITH t AS (SELECT CAST(i AS INTEGER) AS col, vec_id, CAST(embedding[i] > 0 AS INTEGER) AS bit FROM embeddings, range(1, 65) t(i)),
d AS (SELECT col, md5(string_agg(bit, '' ORDER BY vec_id)) AS digest FROM t GROUP BY col)
SELECT col, (SELECT min(b.col) FROM d b WHERE b.digest = a.digest AND b.col % 2 = 0) AS candidate, (SELECT count(*) FROM d b WHERE b.digest = a.digest AND b.col % 2 = 0) AS matches,
  (SELECT count(*) FROM d b WHERE b.digest = a.digest AND b.col % 2 = 0) > 1 AS ambiguous FROM d a""")
def fingerprint_match(spark, sf_dir):
    t = explode_profile(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    bits = t.select(F.col("pos").alias("col"), F.col("id").alias("row"), (F.col("v") > 0).cast("int").alias("bit"))
    return J.fingerprint_match(bits, bits.where("col % 2 = 0"))


@query("lookup_profile", """WITH k AS (SELECT p_partkey, i AS pos, substr(p_type, i, 2) AS kmer FROM part, LATERAL (SELECT unnest(range(1, length(p_type))) AS i)),
t AS (SELECT DISTINCT kmer, CAST((ascii(kmer) * 7 + ascii(substr(kmer, 2, 1))) % 13 AS DOUBLE) AS value FROM k WHERE ascii(kmer) % 2 = 0)
SELECT p_partkey, count(*) AS windows, count(value) AS known, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi FROM k LEFT JOIN t USING (kmer) GROUP BY p_partkey""")
def lookup_profile(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    value = ((F.ascii("kmer") * 7 + F.ascii(F.substring("kmer", 2, 1))) % 13).cast("double")
    empty = spark.createDataFrame([], "kmer string, value double")
    kmers = J.lookup_profile(p, "p_partkey", "p_type", 2, empty).select("kmer").distinct().where(F.ascii("kmer") % 2 == 0).select("kmer", value.alias("value"))
    found = J.lookup_profile(p, "p_partkey", "p_type", 2, kmers)
    return found.groupBy("p_partkey").agg(
        F.count("*").alias("windows"), F.count("value").alias("known"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )


@query("occurrence_join", """WITH s AS (SELECT p_brand AS t, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_partkey AS pos FROM part),
q AS (SELECT 'Brand#' || i AS t FROM range(5, 60) r(i)), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY strand, pos) AS n, count(*) OVER (PARTITION BY t) AS c FROM s)
SELECT q.t, coalesce(c, 0) AS copies, r.strand, r.pos, n = 1 AS first FROM q LEFT JOIN r ON r.t = q.t""")
def occurrence_join(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("t"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("p_partkey").alias("pos"))
    q = spark.range(5, 60).select(F.concat(F.lit("Brand#"), "id").alias("t"))
    return J.occurrences(q, s, "t").withColumn("first", F.when(F.col("strand").isNotNull(), F.col("first")))


@query("fragment_anchor", """WITH a AS (SELECT doc_id, text, lower(substr(text, 5, 12)) AS f FROM documents)
SELECT doc_id, CASE WHEN instr(text, f) > 0 THEN '+' ELSE '-' END AS strand, CASE WHEN instr(text, f) > 0 THEN instr(text, f) ELSE instr(text, reverse(f)) END AS place
FROM a WHERE instr(text, f) > 0 OR instr(text, reverse(f)) > 0""")
def fragment_anchor(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = F.lower(F.substring("text", 5, 12))
    return J.anchor(d, "doc_id", f, F.col("text"), F.reverse(f)).withColumn("place", F.col("place").cast("long"))
