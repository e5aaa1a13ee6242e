"""Off-target search and three-dimensional neighbourhood queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import crowding as C, offtarget as O
from strandloom.plans.registry import query
from strandloom.sources.tables import table

# Texts of 20 letters: the digest of a part's brand in four letters, some of them moved on by the part's number and size.
_TEXTS = """WITH b AS (SELECT p_partkey, p_size, translate(substr(md5(p_brand), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM part),
t AS (SELECT p_partkey, CASE WHEN p_size % 17 <> 3 THEN array_to_string(list_transform(range(1, 21), lambda i: substr('ACGT', CAST((instr('ACGT', substr(b, i, 1)) - 1 + CASE WHEN (p_partkey * i + p_size) % 9 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS BIGINT), 1)), '') END AS s FROM b)"""


def texts(spark, sf_dir):
    base = F.translate(F.substring(F.md5("p_brand"), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    b = table(spark, sf_dir, "part").select("p_partkey", "p_size", base.alias("b"), F.translate(base, "ACGT", "CGTA").alias("moved"))
    # One expression a letter, which is compiled, as a function over an array of them is not.
    letters = [F.when((F.col("p_partkey") * i + F.col("p_size")) % 9 == 0, F.substring("moved", i, 1)).otherwise(F.substring("b", i, 1)) for i in range(1, 21)]
    return b.select("p_partkey", F.when(F.col("p_size") % 17 != 3, F.concat_ws("", *letters)).alias("s"))


@query("family_offtarget", f"""{_TEXTS}, x AS (SELECT a.p_partkey, a.s IS NOT NULL AS ok, hamming(a.s, c.s) AS m, hamming(substr(a.s, 9), substr(c.s, 9)) AS e FROM t a LEFT JOIN t c ON c.s IS NOT NULL AND a.s IS NOT NULL WHERE a.p_partkey % 20 = 0),
n AS (SELECT p_partkey, any_value(ok) AS ok, count(*) FILTER (m = 0) AS c0, {', '.join(f'count(*) FILTER (m = {k}) AS m{k}, count(*) FILTER (m = {k} AND e = 0) AS e{k}' for k in range(1, 5))}, min(m) FILTER (m > 0) AS least FROM x GROUP BY p_partkey)
SELECT p_partkey, CASE WHEN ok THEN c0 END AS "eng.offt.copies", {', '.join(f'CASE WHEN ok THEN m{k} END AS "eng.offt.mm{k}", CASE WHEN ok THEN e{k} END AS "eng.offt.seed_exact_mm{k}"' for k in range(1, 5))},
  CASE WHEN ok THEN m1 + m2 + m3 END AS "eng.offt.le3", CAST(least AS BIGINT) AS "eng.offt.min_mismatch",
  CASE WHEN ok THEN m1 / 4.0::DOUBLE + m2 / 16.0::DOUBLE + m3 / 64.0::DOUBLE + m4 / 256.0::DOUBLE END AS "eng.offt.weighted_burden", CASE WHEN ok THEN CAST(c0 > 1 AS BIGINT) END AS "eng.offt.multi_copy" FROM n""")
def family_offtarget(spark, sf_dir):
    t = texts(spark, sf_dir)
    return O.off_targets(t.where("p_partkey % 20 = 0"), t, "p_partkey")


def points(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), *[e[k].cast("double").alias(a) for k, a in enumerate("xyz")])


@query("crowding_3d", """WITH p AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
d AS (SELECT a.i, b.i AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM p a JOIN p b ON a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM d),
c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p),
f AS (SELECT i, round(avg(d) FILTER (n <= 5), 6) AS "eng.nucl.density.k5", round(avg(d) FILTER (n <= 20), 6) AS "eng.nucl.density.k20",
  CAST(count(*) FILTER (d <= 0.02) AS DOUBLE) AS "eng.nucl.radius.r0.02", CAST(count(*) FILTER (d <= 0.05) AS DOUBLE) AS "eng.nucl.radius.r0.05" FROM r GROUP BY i)
SELECT f.*, round(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz)), 6) AS "eng.nucl.xyz.from_centroid" FROM f JOIN p USING (i), c""")
def crowding_3d(spark, sf_dir):
    out = C.crowding(points(spark, sf_dir), (5, 20), (0.02, 0.05))
    return out.select("i", *[F.round(f"`{c}`", 6).alias(c) for c in out.columns if c != "i"])


_MAP = """WITH m AS (SELECT l_partkey % 97 AS i, l_suppkey * 7 % 97 AS j, l_returnflag AS f, sum(l_quantity) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT CAST(range AS BIGINT) AS i FROM range(97))"""


def contacts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 97).alias("i"), (F.col("l_suppkey") * 7 % 97).alias("j"), F.col("l_returnflag").alias("f")).agg(F.sum("l_quantity").alias("v"))


@query("family_contacts", f"""{_MAP}, a AS (SELECT i, (j - i + 97) % 97 AS a, v FROM m),
s AS (SELECT i, sum(v) AS t, sum(CASE WHEN least(a, 97 - a) <= 10 THEN v ELSE 0 END) AS sh, sum(CASE WHEN a BETWEEN 1 AND 8 THEN v ELSE 0 END) AS r, sum(CASE WHEN 97 - a BETWEEN 1 AND 8 THEN v ELSE 0 END) AS l FROM a GROUP BY i),
e AS (SELECT b.i, coalesce(t, 0) AS t, coalesce(sh, 0) AS sh, coalesce(r, 0) AS r, coalesce(l, 0) AS l FROM b LEFT JOIN s USING (i)),
q AS (SELECT f, i, sum(v) / greatest(sum(sum(v)) OVER (PARTITION BY f), 1) AS w FROM m GROUP BY f, i)
SELECT e.i, round(t, 4) AS "eng.nucl.contacts.total", round(sh, 4) AS "eng.nucl.contacts.short", round(t - sh, 4) AS "eng.nucl.contacts.long", round(log2((sh + 1) / (t - sh + 1)), 6) AS "eng.nucl.contacts.short_long_log2",
  round(CASE WHEN r + l <> 0 THEN (r - l) / (r + l) ELSE 0 END, 6) AS "eng.nucl.insulation", round(log2((coalesce(n.w, 0) + 1e-9) / (coalesce(x.w, 0) + 1e-9)), 6) AS "eng.nucl.dep.r",
  round(log2((coalesce(n.w, 0) + 1e-9) / (coalesce(y.w, 0) + 1e-9)), 6) AS "eng.nucl.dep.a"
FROM e LEFT JOIN (SELECT * FROM q WHERE f = 'N') n ON n.i = e.i LEFT JOIN (SELECT * FROM q WHERE f = 'R') x ON x.i = e.i LEFT JOIN (SELECT * FROM q WHERE f = 'A') y ON y.i = e.i""")
def family_contacts(spark, sf_dir):
    m = contacts(spark, sf_dir)
    of = lambda f: m.where(F.col("f") == f)
    block = C.contact_block(m.groupBy("i", "j").agg(F.sum("v").alias("v")), 97, 10, 8).join(C.dependence({"r": (of("R"), of("N")), "a": (of("A"), of("N"))}, 97), "i")
    digits = {c: 4 if c.endswith(("total", "short", "long")) else 6 for c in block.columns}
    return block.select("i", *[F.round(f"`{c}`", digits[c]).alias(c) for c in block.columns if c != "i"])
