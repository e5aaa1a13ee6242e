"""Feature families of a target and its flanks, on letters made from the parts' names."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators import flank_families as B
from strandloom.plans.aggregate_plans import r6
from strandloom.plans.registry import query
from strandloom.plans.sequence_plans import D, dna
from strandloom.sources.tables import table

STEPS = [a + b for a in "ACGT" for b in "ACGT"]
#: Two scales with a rule for their values, as the letters are made up as well.
SCALES = {"rise": {k: i * 0.5 - 3 for i, k in enumerate(STEPS)}, "roll": {k: (i * 7 % 16) * 0.25 for i, k in enumerate(STEPS)}}
_SCALE = f"""sc(name, k, v) AS (VALUES {', '.join(f"('{n}', '{k}', {v}::DOUBLE)" for n, t in SCALES.items() for k, v in t.items())})"""
PARTS = f"""{D}, p AS (SELECT p_partkey AS "key", substr(s, 1, 8) AS upstream, substr(s, 9, 12) AS target, substr(s, 21, 3) AS pam, substr(s, 24) AS downstream FROM d)"""


def parts(spark, sf_dir):
    s = F.col("s")
    return dna(spark, sf_dir).select(
        F.col("p_partkey").alias("key"), F.substring(s, 1, 8).alias("upstream"), F.substring(s, 9, 12).alias("target"), F.substring(s, 21, 3).alias("pam"), F.substr(s, F.lit(24)).alias("downstream")
    )


def named(df, names):
    return df.select("key", *[F.col(f"`{c}`").alias(n) for n, c in names.items()])


@query("family_shape_windows", f"""{PARTS}, {_SCALE}, w AS (SELECT "key", 'up' AS side, right(upstream, 6) AS t FROM p UNION ALL SELECT "key", 'dn', substr(downstream, 1, 6) FROM p),
v AS (SELECT "key", side, i, name, v FROM w, LATERAL (SELECT unnest(range(1, length(t))) AS i), sc WHERE k = substr(t, i, 2)),
m AS (SELECT "key", avg(v) FILTER (side = 'up' AND name = 'rise') AS up_rise, stddev_pop(v) FILTER (side = 'up' AND name = 'rise') AS up_rise_sd, avg(v) FILTER (side = 'dn' AND name = 'roll') AS dn_roll FROM v GROUP BY 1),
b AS (SELECT "key", i, sum(CASE name WHEN 'rise' THEN v ELSE -v END) AS net FROM v WHERE side = 'up' GROUP BY ALL),
c AS (SELECT "key", sqrt(pow(sum(net * cos(2 * pi() * (i - 1) / 10.5)), 2) + pow(sum(net * sin(2 * pi() * (i - 1) / 10.5)), 2)) / count(*) AS up_bend FROM b GROUP BY 1)
SELECT p."key", round(up_rise, 6) AS up_rise, round(up_rise_sd, 6) AS up_rise_sd, round(dn_roll, 6) AS dn_roll, round(up_bend, 5) AS up_bend FROM p LEFT JOIN m USING ("key") LEFT JOIN c USING ("key")""")
def family_shape_windows(spark, sf_dir):
    out = B.shape_block(parts(spark, sf_dir), SCALES, ("rise", "roll"), [6])
    names = {"up_rise": "eng.shape.rise.up6.mean", "up_rise_sd": "eng.shape.rise.up6.sd", "dn_roll": "eng.shape.roll.dn6.mean"}
    found = named(out, names | {"up_bend": "eng.shape.curv.up6"})
    return found.select("key", *[F.round(c, 6).alias(c) for c in names], F.round("up_bend", 5).alias("up_bend"))


@query("family_methylation_regions", f"""{PARTS}, w AS (SELECT "key", right(upstream, 20) || target || pam || substr(downstream, 1, 20) AS t, least(length(upstream), 20) AS a, least(length(upstream), 20) + length(target) AS b FROM p),
i AS (SELECT "key", t, a, b, i - 1 AS s, 'dam' AS m FROM w, LATERAL (SELECT unnest(range(1, length(t) - 1)) AS i) WHERE substr(t, i, 3) = 'GAT' UNION ALL
  SELECT "key", t, a, b, i - 1, 'dcm' FROM w, LATERAL (SELECT unnest(range(1, length(t) - 1)) AS i) WHERE substr(t, i, 3) IN ('CAG', 'CTG')),
g AS (SELECT "key", count(*) FILTER (m = 'dam') AS dam, count(*) FILTER (m = 'dcm') AS dcm, max(CAST(m = 'dam' AND s < b AND s + 3 > a + 6 AS INTEGER)) AS dam_seed, max(CAST(s < b AND s + 3 > a + 6 AS INTEGER)) AS any_seed,
  count(*) FILTER (m = 'dcm' AND s >= a AND s < b) AS dcm_inside, min(abs(s + 1.5 - (a + 9))) FILTER (m = 'dam') AS dam_nearest FROM i GROUP BY 1)
SELECT "key", CAST(coalesce(dam, 0) AS INTEGER) AS dam, CAST(coalesce(dcm, 0) AS INTEGER) AS dcm, coalesce(dam_seed, 0) AS dam_seed, coalesce(any_seed, 0) AS any_seed, CAST(coalesce(dcm_inside, 0) AS INTEGER) AS dcm_inside,
  coalesce(CAST(dam_nearest AS DOUBLE), length(t)::DOUBLE) AS dam_nearest FROM w LEFT JOIN g USING ("key")""")
def family_methylation_regions(spark, sf_dir):
    out = B.methylation_block(parts(spark, sf_dir), {"dam": ["GAT"], "dcm": ["CAG", "CTG"]}, seed_start=7, cut=9)
    return named(out, {
        "dam": "eng.meth.dam.n_in_window", "dcm": "eng.meth.dcm.n_in_window", "dam_seed": "eng.meth.dam.in_seed", "any_seed": "eng.meth.any_in_seed",
        "dcm_inside": "eng.meth.dcm.n_in_protospacer", "dam_nearest": "eng.meth.dam.nearest_to_cut",
    })


_DG = f"""st(k, g) AS (VALUES {', '.join(f"('{k}', {v[2]}::DOUBLE)" for step, *v in S.STEPS for k in dict.fromkeys((step, step.translate(str.maketrans("ACGT", "TGCA"))[::-1])))})"""


@query("family_mechanics_regions", f"""{PARTS}, {_DG}, e(c, g) AS (VALUES ('G', 0.98::DOUBLE), ('C', 0.98), ('A', 1.03), ('T', 1.03)),
x AS (SELECT "key", 'seed' AS n, 0 AS i, substr(target, 7) AS q FROM p UNION ALL SELECT "key", 'distal', 0, substr(target, 1, 6) FROM p UNION ALL
  SELECT "key", 'w', i, substr(target || pam, i, 5) FROM p, LATERAL (SELECT unnest(range(1, length(target || pam) - 3)) AS i)),
y AS (SELECT "key", n, x.i, q, sum(st.g) AS g FROM x, LATERAL (SELECT unnest(range(1, length(q))) AS j), st WHERE st.k = substr(q, j, 2) GROUP BY ALL),
z AS (SELECT "key", n, i, y.g + a.g + b.g AS g FROM y JOIN e a ON a.c = q[1] JOIN e b ON b.c = q[-1])
SELECT "key", round(max(g) FILTER (n = 'seed') - max(g) FILTER (n = 'distal'), 6) AS split, round(max(g) FILTER (n = 'w'), 6) AS weakest, round(min(g) FILTER (n = 'w'), 6) AS strongest, round(avg(g) FILTER (n = 'w'), 6) AS sliding,
  round(stddev_pop(g) FILTER (n = 'w'), 6) AS spread FROM z GROUP BY 1""")
def family_mechanics_regions(spark, sf_dir):
    out = B.mechanics_block(parts(spark, sf_dir), {"w1_4": (1, 4), "w5_8": (5, 8)}, seed_start=7, flanks=[6])
    names = {"split": "eng.mech.dG.seed_minus_distal", "weakest": "eng.mech.slide.max", "strongest": "eng.mech.slide.min", "sliding": "eng.mech.slide.mean", "spread": "eng.mech.slide.sd"}
    return r6(named(out, names), "key")


@query("family_flank_windows", f"""{PARTS}, {_SCALE}, q AS (SELECT "key", right(upstream, 4) || target || pam || downstream AS t, least(length(upstream), 4) AS a, least(length(upstream), 4) + length(target) AS b, upstream, downstream FROM p)
SELECT "key", CAST(substr(t, a, 1) = 'C' AS INTEGER) AS u1_c, CAST(substr(t, b + 1, 1) = 'G' AS INTEGER) AS pam_g, CAST(coalesce(nullif(substr(t, b + 3 + 2, 1), ''), 'N') = 'T' AS INTEGER) AS d2_t,
  (SELECT v FROM sc WHERE name = 'rise' AND k = substr(t, a - 1, 2)) AS u2_rise, round(length(regexp_replace(right(upstream, 5), '[^GC]', '', 'g')) / length(right(upstream, 5)), 9) AS up_gc FROM q""")
def family_flank_windows(spark, sf_dir):
    out = B.flank_block(parts(spark, sf_dir), SCALES, ["roll"], before=4, after=3, widths=[5])
    found = named(out, {"u1_c": "eng.flank.seq.u1.C", "pam_g": "eng.flank.seq.pamN.G", "d2_t": "eng.flank.seq.d2.T", "u2_rise": "eng.flank.qct.rise.u2", "up_gc": "eng.flank.comp.up5.gc"})
    return found.withColumn("up_gc", F.round("up_gc", 9))


TX = """WITH r AS (SELECT event_id AS "key", event_id * 37 % 9973 + 1 AS place, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand, event_id % 40 AS gene FROM events),
t AS (SELECT DISTINCT o_orderkey * 61 % 9973 + 1 AS tss FROM orders WHERE o_orderkey % 9 = 0), g AS (SELECT p_partkey * 53 % 9973 + 1 AS l, p_partkey * 53 % 9973 + 1 + p_size % 9 AS r, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS s FROM part WHERE p_partkey % 4 = 0),
x AS (SELECT c_nationkey AS gene, round(avg(c_acctbal), 4) AS level FROM customer GROUP BY 1)"""


@query("family_transcription", f"""{TX}, d AS (SELECT place, min(least((place - tss + 9973) % 9973, (tss - place + 9973) % 9973)) AS d FROM (SELECT DISTINCT place FROM r) q, t GROUP BY place),
h AS (SELECT place, max({{'l': l, 'nr': -r}}) AS b FROM (SELECT DISTINCT place FROM r) q JOIN g ON place BETWEEN l AND r GROUP BY place),
j AS (SELECT r."key", r.strand, least(d.d, 5000) AS tss, b.l AS l, -b.nr AS r, (SELECT min(s) FROM g WHERE g.l = b.l AND g.r = -b.nr) AS s, level FROM r JOIN d USING (place) LEFT JOIN h USING (place) LEFT JOIN x USING (gene))
SELECT "key", tss, r - l + 1 AS length, CAST(strand <> s AS DOUBLE) AS template, level, round((level - avg(level) OVER ()) * (CAST(strand <> s AS DOUBLE) - 0.5), 4) AS interaction FROM j""")
def family_transcription(spark, sf_dir):
    e, k, p = F.col("event_id"), F.col("o_orderkey"), F.col("p_partkey")
    rows = table(spark, sf_dir, "events").select(e.alias("key"), (e * 37 % 9973 + 1).alias("place"), F.when(e % 2 == 0, "+").otherwise("-").alias("strand"), (e % 40).cast("int").alias("gene"))
    starts = table(spark, sf_dir, "orders").where(k % 9 == 0).select((k * 61 % 9973 + 1).alias("tss"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))
    left = p * 53 % 9973 + 1
    genes = table(spark, sf_dir, "part").where(p % 4 == 0).select(left.alias("left"), (left + F.col("p_size") % 9).alias("right"), F.when(p % 3 == 0, "-").otherwise("+").alias("strand"))
    expression = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("gene")).agg(F.round(F.avg("c_acctbal"), 4).alias("level"))
    out = B.transcription_block(rows, starts, genes, expression, 9973, 400, 5400)
    found = named(out, {"tss": "eng.tx.tss.any", "length": "eng.tx.gene.length", "template": "eng.tx.gene.template_strand", "level": "eng.tx.expr.level", "interaction": "eng.tx.ix.expr_x_template"})
    return found.withColumn("interaction", F.round("interaction", 4))
