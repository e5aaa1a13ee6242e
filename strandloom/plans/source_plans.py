"""Source and sink queries: tables written in a foreign format to the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators.joins import remaining
from strandloom.plans.registry import query
from strandloom.sources import files as S
from strandloom.sources.tables import table
from strandloom.sources.workspace import work_folder


# Every third name and every fifth size is missing, so cells behind the key are empty.
@query("titled_csv_round_trip", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS p_name, p_brand, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS p_size, p_retailprice FROM part")
def titled_csv_round_trip(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 3 > 0, F.col("p_name")).alias("p_name"), "p_brand", F.when(key % 5 > 0, F.col("p_size")).alias("p_size"), "p_retailprice"
    )
    path = work_folder(spark, "titled-csv")
    S.write_titled_csv(p, path, "Parts of the catalogue")
    return S.read_titled_csv(spark, path, p.schema, "p_partkey")


@query("context_scores_scan", "SELECT p_type || ',' || p_name AS context, p_retailprice AS score FROM part")
def context_scores_scan(spark, sf_dir):
    path = work_folder(spark, "contexts")
    table(spark, sf_dir, "part").select(F.concat_ws(",", "p_type", "p_name", F.col("p_retailprice").cast("string"))).write.text(path)
    return S.read_context_scores(spark, [path])


@query("wiggle_dense_track", """WITH s AS (SELECT event_id * 3 AS pos, round(value, 3) AS value FROM events)
SELECT i AS pos, coalesce(value, 0) AS value FROM (SELECT unnest(range(1, (SELECT max(pos) FROM s) + 1)) AS i) t LEFT JOIN s ON s.pos = i""")
def wiggle_dense_track(spark, sf_dir):
    path = work_folder(spark, "wiggle")
    e = table(spark, sf_dir, "events")
    last = 3 * (e.agg(F.max("event_id")).first()[0] or 0)
    lines = e.select(F.concat_ws("\t", (F.col("event_id") * 3).cast("string"), F.round("value", 3).cast("string")).alias("value"))
    spark.createDataFrame([("track type=wiggle_0",), ("variableStep chrom=c",)], "value string").unionByName(lines).write.text(path)
    return S.read_wiggle(spark, path, last)


@query("fasta_scan", "SELECT 'p' || p_partkey AS name, upper(regexp_replace(p_name || p_type, '\\s', '', 'g')) AS bases FROM part")
def fasta_scan(spark, sf_dir):
    path = work_folder(spark, "fasta")
    record = F.concat(F.lit(">p"), "p_partkey", F.lit(" part\n"), F.lower("p_name"), F.lit("\n"), F.lower("p_type"))
    table(spark, sf_dir, "part").select(record).write.text(path)
    return S.read_fasta(spark, path)


@query("matrix_scan", "SELECT vec_id AS i, CAST(j - 1 AS INTEGER) AS j, round(embedding[j]::DOUBLE, 6) AS v FROM embeddings, range(1, 65) t(j)")
def matrix_scan(spark, sf_dir):
    path = work_folder(spark, "matrix")
    cells = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")
    table(spark, sf_dir, "embeddings").select(F.concat_ws(" ", F.col("vec_id").cast("string"), cells)).write.text(path)
    return S.read_matrix(spark, path).withColumn("v", F.round("v", 6))


@query("lookup_json_round_trip", "SELECT p_brand AS unit, p_type AS property, p_name AS kmer, round(avg(p_retailprice), 4) AS value FROM part GROUP BY ALL")
def lookup_json_round_trip(spark, sf_dir):
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("unit"), F.col("p_type").alias("property"), F.col("p_name").alias("kmer")).agg(F.round(F.avg("p_retailprice"), 4).alias("value"))
    return S.lookup_rows(S.lookup_json(p))


@query("append_and_resume", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 2")
def append_and_resume(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    path = work_folder(spark, "checkpoint")
    done = S.read_if_any(spark, path, "o_orderkey long, o_custkey long")
    assert not done.take(1)
    for k in (0, 1):
        S.append_checkpoint(o.where(F.col("o_orderkey") % 3 == k), path)
    return remaining(o, S.read_if_any(spark, path, "o_orderkey long, o_custkey long"), ["o_orderkey"])


@query("replicate_mean_tracks", """SELECT event_type AS role, event_id % 500 AS pos, round(avg(value), 6) AS value FROM events GROUP BY ALL""")
def replicate_mean_tracks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("event_id") % 500).alias("pos"), "value")
    part = lambda kind, k: e.where((F.col("event_type") == kind) & (F.col("event_id") % 2 == k))
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # roles, a handful
    return S.mean_tracks({kind: [part(kind, 0), part(kind, 1)] for kind in kinds}).withColumn("value", F.round("value", 6))
