"""Sequence queries; the letters of texts are mapped onto ACGT where the operator needs that alphabet."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.plans.registry import query
from strandloom.sources.tables import table

#: Texts a task whose k-mers are grouped at most.
TEXTS = 25_000

# Every letter of p_name and p_type becomes one of ACGT.
AZ, TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "ACGTACGTACGTACGTACGTACGTACG"
DNA = f"translate(upper(p_name || p_type), '{AZ}', '{TO}')"
KEEP = f"regexp_replace({DNA}, '[^ACGT]', '', 'g')"


def dna(spark, sf_dir):
    s = F.translate(F.upper(F.concat("p_name", "p_type")), AZ, TO)
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(s, "[^ACGT]", "").alias("s"))


def dealt(df, key):
    """Texts dealt by their key, so many a task that its k-mers fit whatever the rows; an explicit number is not coalesced."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TEXTS)), key)


D = f"WITH d AS (SELECT p_partkey, {KEEP} AS s FROM part)"
RC = "reverse(translate({}, 'ACGT', 'TGCA'))"


@query("revcomp_canonical", f"""{D}, k AS (SELECT p_partkey, substr(s, i, 5) AS k FROM d, LATERAL (SELECT unnest(range(1, length(s) - 3)) AS i)),
c AS (SELECT p_partkey, least(k, {RC.format('k')}) AS c FROM k) SELECT c AS kmer, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM c GROUP BY 1""")
def revcomp_canonical(spark, sf_dir):
    k = dealt(dna(spark, sf_dir), "p_partkey").select("p_partkey", F.explode(S.kmers(F.col("s"), 5)).alias("k")).select("p_partkey", S.canonical(F.col("k")).alias("kmer"))
    # A part's texts are in one task, so its k-mers meet there without another shuffle.
    return k.groupBy("p_partkey", "kmer").agg(F.count("*").alias("n")).groupBy("kmer").agg(F.sum("n").alias("n"), F.count("p_partkey").alias("parts"))


@query("kmer_uniqueness", f"""{D}, k AS (SELECT p_partkey, i AS pos, least(substr(s, i, 12), {RC.format('substr(s, i, 12)')}) AS c FROM d, LATERAL (SELECT unnest(range(1, length(s) - 10)) AS i)),
u AS (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM k) SELECT p_partkey, count(*) AS windows, count(*) FILTER (n = 1) AS "unique" FROM u GROUP BY 1""")
def kmer_uniqueness(spark, sf_dir):
    k = dealt(dna(spark, sf_dir), "p_partkey").select("p_partkey", F.explode(S.kmers(F.col("s"), 12)).alias("k")).select("p_partkey", S.canonical(F.col("k")).alias("c"))
    # Counts meet by k-mer first, so a common k-mer is one row of the join's other side.
    counts = k.groupBy("c").agg(F.count("*").alias("n"))
    return k.groupBy("p_partkey", "c").agg(F.count("*").alias("w")).join(counts, "c").groupBy("p_partkey").agg(F.sum("w").alias("windows"), F.sum(F.when(F.col("n") == 1, F.col("w")).otherwise(0)).alias("unique"))


@query("circular_slice", f"""{D} SELECT p_partkey, substr(s || s || s, ((p_partkey * 7 - 1) % length(s) + length(s)) % length(s) + 1, 9) AS cut, {RC.format("substr(s || s || s, ((p_partkey * 7 - 1) % length(s) + length(s)) % length(s) + 1, 9)")} AS back FROM d""")
def circular_slice(spark, sf_dir):
    cut = S.slice_circular(F.col("s"), F.col("p_partkey") * 7, F.lit(9))
    return dna(spark, sf_dir).select("p_partkey", cut.alias("cut"), S.revcomp(cut).alias("back"))


@query("circular_distance", """SELECT event_id, least(d, 5003 - d) AS distance, CASE WHEN e * 2 > 5003 THEN e - 5003 ELSE e END AS "offset" FROM (
SELECT event_id, abs(event_id * 31 % 5003 - event_id * 17 % 5003) % 5003 AS d, ((event_id * 31 % 5003 - event_id * 17 % 5003) % 5003 + 5003) % 5003 AS e FROM events)""")
def circular_distance(spark, sf_dir):
    a, b = F.col("event_id") * 31 % 5003, F.col("event_id") * 17 % 5003
    return table(spark, sf_dir, "events").select("event_id", S.circular_distance(a, b, 5003).alias("distance"), S.signed_offset(a, b, 5003).alias("offset"))


@query("motif_overlap", f"""{D} SELECT p_partkey, len(list_filter(range(1, length(s) - 1), lambda i: substr(s, i, 3) = 'ACA')) AS aca, len(list_filter(range(1, length(s) - 2), lambda i: regexp_matches(substr(s, i, 4), '^C[AT]GC$'))) AS cwgc,
  coalesce(list_filter(range(1, length(s) - 1), lambda i: substr(s, i, 3) = 'ACA')[1], 0) AS first FROM d""")
def motif_overlap(spark, sf_dir):
    found = S.find_all(F.col("s"), "ACA")
    return dna(spark, sf_dir).select(
        "p_partkey", F.size(found).cast("long").alias("aca"), S.count_overlapping(F.col("s"), "C[AT]GC").cast("long").alias("cwgc"), F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(0)).cast("long").alias("first")
    )


@query("composition_entropy", f"""{D}, c AS (SELECT p_partkey, length(s) AS n, length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'C', '')) AS c, length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'T', '')) AS t FROM d)
SELECT p_partkey, round((c + g) / n, 9) AS gc, round((a + g) / n, 9) AS purine, round(-(greatest(a / n, 1e-9) * log2(greatest(a / n, 1e-9)) + greatest(c / n, 1e-9) * log2(greatest(c / n, 1e-9)) + greatest(g / n, 1e-9) * log2(greatest(g / n, 1e-9)) + greatest(t / n, 1e-9) * log2(greatest(t / n, 1e-9))), 6) AS entropy FROM c""")
def composition_entropy(spark, sf_dir):
    s = F.col("s")
    return dna(spark, sf_dir).select(
        "p_partkey", F.round(S.letter_share(s, "GC"), 9).alias("gc"), F.round(S.letter_share(s, "AG"), 9).alias("purine"), F.round(S.entropy([S.letter_share(s, x) for x in "ACGT"]), 6).alias("entropy")
    )


@query("kmer_indicators", f"""{D} SELECT p_partkey, i AS pos, substr(s, i, 2) AS kmer FROM d, LATERAL (SELECT unnest(range(1, 9)) AS i)
WHERE (i, substr(s, i, 2)) IN (SELECT (i, k) FROM (SELECT i, substr(s, i, 2) AS k, count(*) AS n FROM d, LATERAL (SELECT unnest(range(1, 9)) AS i) GROUP BY ALL) WHERE n < (SELECT count(*) FROM d))""")
def kmer_indicators(spark, sf_dir):
    rows = dna(spark, sf_dir).select("p_partkey", F.posexplode(F.slice(S.kmers(F.col("s"), 2), 1, 8)).alias("p", "kmer")).select("p_partkey", (F.col("p") + 1).cast("long").alias("pos"), "kmer")
    n = table(spark, sf_dir, "part").count()
    constant = rows.groupBy("pos", "kmer").count().where(F.col("count") >= n)
    return rows.join(constant.select("pos", "kmer"), ["pos", "kmer"], "left_anti").select("p_partkey", "pos", "kmer")


@query("motif_sites", f"""{D} SELECT p_partkey, '+' AS strand, i AS place, substr(s, i, 6) AS target FROM d, LATERAL (SELECT unnest(range(1, greatest(length(s) - 6, 1))) AS i) WHERE substr(s, i + 6, 2) = 'GG'
UNION ALL SELECT p_partkey, '-', i + 2, {RC.format('substr(s, i + 2, 6)')} FROM d, LATERAL (SELECT unnest(range(1, greatest(length(s) - 6, 1))) AS i) WHERE substr(s, i, 2) = 'CC'""")
def motif_sites(spark, sf_dir):
    return S.motif_sites(dna(spark, sf_dir), "p_partkey", "s", 6, "GG").withColumn("place", F.col("place").cast("long"))


_pairs = [(k, *v) for step, *v in S.STEPS for k in dict.fromkeys((step, step.translate(str.maketrans("ACGT", "TGCA"))[::-1]))]
_end = lambda gc, at: f"CASE WHEN q[1] IN ('G', 'C') THEN {gc} ELSE {at} END + CASE WHEN q[-1] IN ('G', 'C') THEN {gc} ELSE {at} END"


# Every eleventh text has an unknown letter, every thirteenth is one letter long.
@query("duplex_thermodynamics", f"""{D}, o AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN s[:3] || 'N' || s[4:] WHEN p_partkey % 13 = 0 THEN s[:1] ELSE s END AS q FROM d),
t(k, h, s, g) AS (VALUES {', '.join(f"('{k}', {h}::DOUBLE, {s}::DOUBLE, {g}::DOUBLE)" for k, h, s, g in _pairs)}),
x AS (SELECT p_partkey, q, sum(t.h) AS h, sum(t.s) AS e, sum(t.g) AS g FROM o, LATERAL (SELECT unnest(range(1, length(q))) AS i), t WHERE t.k = substr(q, i, 2) AND regexp_full_match(q, '[ACGT]+') GROUP BY ALL),
y AS (SELECT p_partkey, h + {_end(0.1, 2.3)} AS dh, e + {_end(-2.8, 4.1)} AS ds, g + {_end(0.98, 1.03)} AS dg37 FROM x)
SELECT p_partkey, round(dh, 5) AS dh, round(ds, 5) AS ds, round(dg37, 8) AS dg37, round(1000 * dh / (ds + 1.987 * ln(5e-7 / 4)) - 273.15, 5) AS tm FROM o LEFT JOIN y USING (p_partkey)""")
def duplex_thermodynamics(spark, sf_dir):
    s, key = F.col("s"), F.col("p_partkey")
    odd = F.when(key % 11 == 0, F.concat(F.substring(s, 1, 3), F.lit("N"), F.substr(s, F.lit(4)))).when(key % 13 == 0, F.substring(s, 1, 1)).otherwise(s)
    out = dna(spark, sf_dir).select("p_partkey", S.duplex(odd).alias("x"))
    return out.select("p_partkey", *[F.round(f"x.{c}", 8 if c == "dg37" else 5).alias(c) for c in ("dh", "ds", "dg37", "tm")])


@query("strand_context", f"""{D}, c AS (SELECT p_partkey, s || s || s AS g, length(s) AS n, s, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM d),
u AS (SELECT p_partkey, strand, substr(g, n + 5 - 4, 4) AS up, substr(g, n + 5, 6) AS mid, substr(g, n + 11, 4) AS down FROM c)
SELECT p_partkey, CASE strand WHEN '+' THEN up ELSE {RC.format('down')} END AS upstream, CASE strand WHEN '+' THEN mid ELSE {RC.format('mid')} END AS target, CASE strand WHEN '+' THEN down ELSE {RC.format('up')} END AS downstream,
  CAST(CASE strand WHEN '+' THEN 7 ELSE 8 END AS INTEGER) AS cut FROM u""")
def strand_context(spark, sf_dir):
    strand = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    c = S.context(F.col("s"), F.lit(5), F.lit(10), strand, 4)
    return dna(spark, sf_dir).select("p_partkey", c.alias("c"), S.cut_site(F.lit(5), F.lit(10), strand).alias("cut")).select("p_partkey", "c.*", "cut")


@query("axis_halves", """SELECT event_id, (((event_id * 13 % 10007 - 400) % 10007 + 10007) % 10007) < (5400 - 400) AS first_half, round(log2((value + 1e-4) / (abs(value) / 2 + 1 + 1e-4)), 6) AS log_ratio FROM events WHERE value >= 0""")
def axis_halves(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value >= 0")
    return e.select("event_id", S.before_terminus(F.col("event_id") * 13 % 10007, 400, 5400, 10007).alias("first_half"), F.round(S.log_ratio(F.col("value"), F.abs("value") / 2 + 1), 6).alias("log_ratio"))


@query("json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, round(try_cast(json_extract_string(props, '$.k') AS DOUBLE) * 2, 6) AS twice FROM events")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.round(F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)") * 2, 6).alias("twice"))
