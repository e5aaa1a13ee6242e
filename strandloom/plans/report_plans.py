"""Redundancy, family and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import families, interpret as I
from strandloom.operators.ordering import top_k, with_running_sum
from strandloom.plans.aggregate_plans import r6
from strandloom.plans.profile_plans import TIDY, tidy
from strandloom.plans.registry import query
from strandloom.plans.sequence_plans import D, dna
from strandloom.sources.tables import table
from strandloom.sources.workspace import stored, work_folder
from strandloom.streaming.resume import resume_stream, run_windowed_means

CORR = f"""{TIDY}, c AS (SELECT a.pos AS i, b.pos AS j, covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) AS r FROM p a JOIN p b ON a.id = b.id AND a.pos < b.pos GROUP BY ALL)"""


@query("column_correlations", f"{CORR} SELECT i, j, round(r, 6) AS r FROM c")
def column_correlations(spark, sf_dir):
    return r6(I.column_correlations(tidy(spark, sf_dir)), "i", "j")


@query("nearest_correlate", f"""{CORR}, b AS (SELECT i AS col, j, abs(r) AS s FROM c UNION ALL SELECT j, i, abs(r) FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY s DESC, j) AS n FROM b)
SELECT col, j AS nearest, round(s, 6) AS size FROM o WHERE n = 1""")
def nearest_correlate(spark, sf_dir):
    return r6(I.nearest_correlate(I.column_correlations(tidy(spark, sf_dir))), "col")


# Rows dealt anew: the rank of an id in one md5 order takes the row of the same rank in another.
@query("nearest_with_null", """WITH p AS (SELECT vec_id AS id, CAST(i AS INTEGER) AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
k AS (SELECT vec_id AS id, row_number() OVER (ORDER BY substr(md5('-1:' || vec_id), 1, 3), md5('-1:' || vec_id), vec_id) AS a, row_number() OVER (ORDER BY substr(md5('5:' || vec_id), 1, 3), md5('5:' || vec_id), vec_id) AS b FROM embeddings),
m AS (SELECT x.id, y.id AS source FROM k x JOIN k y ON x.a = y.b),
o AS (SELECT l.pos AS col, r.pos AS j, abs(corr(l.v, r.v)) AS s FROM p l JOIN p r USING (id) WHERE l.pos <= 24 AND r.pos > 24 GROUP BY ALL),
n AS (SELECT l.pos AS col, r.pos AS j, abs(corr(l.v, r.v)) AS s FROM m JOIN p l ON l.id = m.source JOIN p r ON r.id = m.id WHERE l.pos <= 24 AND r.pos > 24 GROUP BY ALL),
b AS (SELECT col, j AS nearest, s AS size FROM o QUALIFY row_number() OVER (PARTITION BY col ORDER BY s DESC, j) = 1)
SELECT b.col, nearest, round(size, 6) AS size, round(max(n.s), 6) AS null_size FROM b JOIN n USING (col) GROUP BY b.col, nearest, size""")
def nearest_with_null(spark, sf_dir):
    p = tidy(spark, sf_dir)
    out = I.nearest_with_null(p.where("pos <= 24"), p.where("pos > 24"), 5, columns=16)
    return out.select("col", "nearest", F.round("size", 6).alias("size"), F.round("null_size", 6).alias("null_size"))


@query("greedy_clusters")
def greedy_clusters(spark, sf_dir):
    found = I.greedy_clusters(I.column_correlations(tidy(spark, sf_dir)), range(1, 65), 0.15)
    return spark.createDataFrame(sorted(found.items()), "col int, seed int")


@query("residual_headroom", f"""{TIDY}, e AS (SELECT vec_id AS id, label - (SELECT avg(label) FROM embeddings) AS e FROM embeddings), x AS (SELECT pos, v, e FROM p JOIN e USING (id)),
r AS (SELECT pos, rank() OVER (PARTITION BY pos ORDER BY v) + (count(*) OVER (PARTITION BY pos, v) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY pos ORDER BY e) + (count(*) OVER (PARTITION BY pos, e) - 1) / 2.0::DOUBLE AS re FROM x)
SELECT pos, count(*) AS n, round(covar_pop(rv, re) / (stddev_pop(rv) * stddev_pop(re)), 6) AS rho FROM r GROUP BY pos HAVING count(*) >= 200""")
def residual_headroom(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    mean = e.agg(F.avg("label").alias("m"))
    return r6(I.headroom(tidy(spark, sf_dir), e.join(F.broadcast(mean)).select("id", (F.col("label") - F.col("m")).alias("e"))), "pos")  # one row


@query("linear_attribution", f"""{TIDY}, m AS (SELECT *, avg(v) OVER (PARTITION BY pos) AS m FROM p) SELECT pos, round(abs((pos % 7) - 3.0::DOUBLE) * avg(abs(v - m)), 6) AS importance FROM m GROUP BY pos""")
def linear_attribution(spark, sf_dir):
    w = spark.range(1, 65).select(F.col("id").cast("int").alias("pos"), (F.col("id") % 7 - 3.0).alias("w"))
    return r6(I.linear_attribution(tidy(spark, sf_dir), w), "pos")


@query("importance_agreement", f"""{TIDY}, i AS (SELECT (id % 4) AS model, pos, avg(abs(v)) AS value FROM p GROUP BY ALL), q AS (SELECT a.model AS a, b.model AS b, a.value AS x, b.value AS y FROM i a JOIN i b ON a.pos = b.pos AND a.model < b.model),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) AS ry FROM q)
SELECT a, b, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) AS rho FROM r GROUP BY a, b""")
def importance_agreement(spark, sf_dir):
    i = tidy(spark, sf_dir).groupBy((F.col("id") % 4).alias("model"), "pos").agg(F.avg(F.abs("v")).alias("value"))
    return r6(I.importance_agreement(i), "a", "b")


@query("alternative_label", "SELECT d.doc_id, n_chars, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL")
def alternative_label(spark, sf_dir):
    return I.with_label(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", "quality")


@query("stratified_means", """WITH s AS (SELECT 'cheap' AS stratum, * FROM orders WHERE o_totalprice < 100000 UNION ALL SELECT 'dear', * FROM orders WHERE o_totalprice >= 100000 UNION ALL SELECT 'open', * FROM orders WHERE o_orderstatus = 'O')
SELECT stratum, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM s GROUP BY 1""")
def stratified_means(spark, sf_dir):
    p = F.col("o_totalprice")
    rows = I.stratified(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus"), {"cheap": p < 100000, "dear": p >= 100000, "open": F.col("o_orderstatus") == "O"})
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("screen_disagreement", """WITH s AS (SELECT l_partkey, round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 6) AS a, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 6) AS b FROM lineitem GROUP BY 1),
r AS (SELECT l_partkey, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb, count(*) OVER () AS n FROM s WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT l_partkey, round((ra - rb) / n, 9) AS gap FROM r""")
def screen_disagreement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice")
    mean = lambda flag: li.where(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("v"))
    return I.screen_disagreement(mean("A"), mean("R"), "l_partkey", "v").withColumn("gap", F.round("gap", 9))


# Users are keys, so those with events in several folds fail; fold 5 never occurs; sets are the ten users with the greatest values, repeats included.
@query("fold_verification", """WITH e AS (SELECT user_id, event_id % 5 AS fold, event_id, value FROM events), s AS (SELECT fold, user_id AS item FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY value DESC, event_id) AS n FROM e) WHERE n <= 10)
SELECT 'key in one fold' AS "check", (SELECT count(*) FROM (SELECT user_id FROM e GROUP BY 1 HAVING count(DISTINCT fold) <> 1)) AS failures
UNION ALL SELECT 'no fold empty', 6 - (SELECT count(DISTINCT fold) FROM e)
UNION ALL SELECT 'sets complete', (SELECT count(*) FROM (SELECT fold FROM s GROUP BY 1 HAVING count(*) <> 10 OR count(DISTINCT item) <> 10))""")
def fold_verification(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("fold"), "value")
    top = top_k(e, ["fold"], [F.desc("value"), F.col("event_id")], 10).select("fold", F.col("user_id").alias("item"))
    return I.verify_folds(e, top, "user_id", "fold", 6, 10)


@query("family_flank", f"""{D}, l AS (SELECT p_partkey, length(s) AS n, i, substr(s, i, 1) AS ch FROM d, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY p_partkey, ch ORDER BY i) AS g FROM l), r AS (SELECT p_partkey, n, count(*) AS k FROM g GROUP BY p_partkey, n, ch, g), m AS (SELECT p_partkey, max(k) / n AS run FROM r GROUP BY p_partkey, n)
SELECT d.p_partkey AS "key", round(length(regexp_replace(substr(s, 1, 10), '[^GC]', '', 'g')) / length(substr(s, 1, 10)), 9) AS gc10, round(length(regexp_replace(substr(s, 1, 20), '[^AG]', '', 'g')) / length(substr(s, 1, 20)), 9) AS purine20, round(run, 9) AS run FROM d JOIN m USING (p_partkey)""")
def family_flank(spark, sf_dir):
    out = families.flank(dna(spark, sf_dir).withColumnRenamed("p_partkey", "key"))
    return out.select("key", F.round("`eng.flank.gc10`", 9).alias("gc10"), F.round("`eng.flank.purine20`", 9).alias("purine20"), F.round("`eng.flank.run`", 9).alias("run"))


@query("family_blocks")
def family_blocks(spark, sf_dir):
    rows = dna(spark, sf_dir).select(F.col("p_partkey").alias("key"), "s", F.lit("+").alias("strand"), (F.col("p_partkey") % 10_007 + 1).alias("place"))
    out, status = families.build(rows, registry={"z_dosage": lambda r: families.dosage(r, 10_007)})
    assert set(status.values()) == {"ok"}, status
    return out


@query("family_gradient", """WITH t AS (SELECT event_id + 1 AS pos, value, max(event_id) OVER () + 1 AS n FROM events),
r AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS s, CASE WHEN p_size % 10 <> 3 THEN p_partkey * 37 % (SELECT max(n) FROM t) + 1 END AS place FROM part),
w AS (SELECT p_partkey, s, w, d, avg(value) AS m FROM r, (VALUES (20), (90)) v(w), (VALUES (1), (-1)) x(d), LATERAL (SELECT unnest(range(0, w)) AS k), t WHERE t.pos = (((place + d * (w // 2) - w // 2 + k - 1) % n) + n) % n + 1 GROUP BY ALL)
SELECT r.p_partkey AS "key", round(sum(r.s * d * m) FILTER (w = 20), 6) AS "eng.track.gradient20", round(sum(r.s * d * m) FILTER (w = 90), 6) AS "eng.track.gradient90" FROM r LEFT JOIN w USING (p_partkey) GROUP BY r.p_partkey""")
def family_gradient(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("pos"), "value")
    n = e.agg(F.max("pos")).first()[0]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"), F.when(F.col("p_size") % 10 != 3, F.col("p_partkey") * 37 % n + 1).alias("place"))
    out = families.torsion_gradient(rows, e, [20, 90], n)
    return out.select("key", *[F.round(f"`{c}`", 6).alias(c) for c in out.columns if c != "key"])


_BASES = """WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS pos, substr('ACGT', CAST(1 + ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6))::BIGINT % 4 AS BIGINT), 1) AS base FROM (SELECT DISTINCT o_custkey AS o_orderkey FROM orders)),
n AS (SELECT count(*) AS n FROM b)"""


@query("family_mapgc", f"""{_BASES}, k AS (SELECT a.pos, string_agg(c.base, '' ORDER BY i) AS kmer FROM b a, n, range(0, 5) t(i), b c WHERE c.pos = (a.pos - 1 + i) % n + 1 GROUP BY a.pos),
c AS (SELECT pos, least(kmer, translate(reverse(kmer), 'ACGT', 'TGCA')) AS c FROM k), u AS (SELECT pos, CAST(count(*) OVER (PARTITION BY c) = 1 AS DOUBLE) AS u FROM c),
t AS (SELECT pos, u, CAST(base IN ('G', 'C') AS DOUBLE) AS g FROM u JOIN b USING (pos)),
r AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 3 THEN p_partkey * 37 % n + 1 END AS place FROM part, n),
w AS (SELECT p_partkey, w, avg(u) AS u, avg(g) AS g FROM r, n, (VALUES (10), (25), (50), (75)) v(w), LATERAL (SELECT unnest(range(0, w)) AS i), t WHERE t.pos = (((place - w // 2 + i - 1) % n) + n) % n + 1 GROUP BY ALL)
SELECT r.p_partkey AS "key", {', '.join(f'round(max({c}) FILTER (w = {x}), 9) AS "eng.map.{m}{x}"' for m, c in (("unique", "u"), ("gc", "g")) for x in (10, 25, 50, 75))} FROM r LEFT JOIN w USING (p_partkey) GROUP BY r.p_partkey""")
def family_mapgc(spark, sf_dir):
    """A circle of letters from the customers with orders, in the order of their numbers."""
    letters = F.substr(F.lit("ACGT"), (F.conv(F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 6), 16, 10).cast("long") % 4 + 1).cast("int"), F.lit(1))
    own = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    bases = stored(with_running_sum(own, "o_custkey", F.lit(1), "pos").select("pos", letters.alias("base")), "bases")
    n = bases.count()
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 10 != 3, F.col("p_partkey") * 37 % n + 1).alias("place"))
    out = families.mapgc_block(rows, bases, 5, [10, 25, 50, 75], n)
    return out.select("key", *[F.round(f"`{c}`", 9).alias(c) for c in out.columns if c != "key"])


@query("family_tracks", """WITH t AS (SELECT event_id + 1 AS pos, value, max(event_id) OVER () + 1 AS n FROM events), r AS (SELECT p_partkey, p_partkey * 37 % (SELECT max(n) FROM t) + 1 AS place FROM part),
w AS (SELECT p_partkey, w, avg(value) AS m FROM r, (VALUES (10), (100)) v(w), LATERAL (SELECT unnest(range(0, w)) AS k), t WHERE t.pos = (((place - w // 2 + k - 1) % n) + n) % n + 1 GROUP BY ALL)
SELECT p_partkey AS "key", round(max(m) FILTER (w = 10), 6) AS narrow, round(max(m) FILTER (w = 100), 6) AS wide, round(log2((max(m) FILTER (w = 10) + 1e-4) / (max(m) FILTER (w = 100) + 1e-4)), 5) AS ratio FROM w GROUP BY 1""")
def family_tracks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("a").alias("role"), (F.col("event_id") + 1).alias("pos"), "value")
    n = e.agg(F.max("pos")).first()[0]
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") * 37 % n + 1).alias("place"))
    out = families.track_block(rows, e, ["a"], [10, 100], n)
    return out.select("key", F.round("`eng.track.a10`", 6).alias("narrow"), F.round("`eng.track.a100`", 6).alias("wide"), F.round("`eng.track.a10.ratio`", 5).alias("ratio"))


@query("family_neighbourhood", """WITH c AS (SELECT event_id % 50 AS i, event_id * 7 % 50 AS j, value AS v FROM events), s AS (SELECT i AS bin, round(sum(v) FILTER (least((i - j + 50) % 50, (j - i + 50) % 50) <= 5), 6) AS near, round(sum(v) FILTER (least((i - j + 50) % 50, (j - i + 50) % 50) > 5), 6) AS far, count(*) AS n FROM c GROUP BY i)
SELECT p_partkey AS "key", n, coalesce(near, 0) AS near, coalesce(far, 0) AS far, CAST(p_size > 25 AS INTEGER) AS big FROM part JOIN s ON bin = (p_partkey // 10) % 50""")
def family_neighbourhood(spark, sf_dir):
    c = table(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("i"), (F.col("event_id") * 7 % 50).alias("j"), F.col("value").alias("v"))
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("key"), (F.col("p_partkey") + 1).alias("place"))
    bins = c.groupBy(F.col("i").alias("bin")).agg(F.count("*").alias("n"))
    block = families.neighbourhood_block(rows, bins, c, 10, 50, 5).join(families.membership_block(rows, part.where("p_size > 25").select(F.col("p_partkey").alias("key")), "big"), "key")
    return block.select("key", "n", F.round("`eng.contact.near`", 6).alias("near"), F.round("`eng.contact.far`", 6).alias("far"), F.col("`eng.big`").alias("big"))


@query("stream_resume", "SELECT event_id, user_id, value FROM events")
def stream_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    schema = "event_id long, user_id long, value double"
    source, target, state = (work_folder(spark, f"resume-{x}") for x in ("source", "target", "state"))
    for half in (0, 1):  # the second run meets the rows of the first again, and new ones
        e.where(F.col("event_id") % 2 <= half).write.mode("append").parquet(source)
        resume_stream(spark, source, schema, target, ["event_id"], state)
    return spark.read.parquet(target)


# A window closes when the latest event is an hour past its end, so the last day stays open.
@query("stream_windowed_means", """SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL""")
def stream_windowed_means(spark, sf_dir):
    source = work_folder(spark, "windows-source")
    table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(source)
    out = run_windowed_means(spark, source, "ts timestamp, event_type string, value double", "ts", "event_type", "value")
    return out.select(F.date_format(F.col("start"), "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", F.round("mean", 6).alias("mean"), "n")
