"""K-mers are grouped where their part's texts lie, a bounded number of texts a task, repeated and NULL keys included."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.plans import offtarget_plans as O, sequence_plans as Q

PARTS = "p_partkey long, p_name string, p_type string, p_brand string, p_size int"


@pytest.fixture
def parts(spark, tmp_path):
    rows = [(i % 40 if i % 9 else None, f"name {'azure'[: i % 6]} {i}", f"TYPE {i * i}", f"Brand#{i % 4}", i % 21) for i in range(90)]
    spark.createDataFrame(rows, PARTS).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_canonical_counts_and_tasks(spark, parts, monkeypatch):
    monkeypatch.setattr(Q, "TEXTS", 4)
    got = Q.revcomp_canonical(spark, parts)
    n, keys = defaultdict(int), defaultdict(set)
    for r in Q.dna(spark, parts).collect():
        for i in range(len(r.s) - 4):
            k = r.s[i : i + 5]
            c = min(k, k.translate(str.maketrans("ACGT", "TGCA"))[::-1])
            n[c] += 1
            keys[c] |= {r.p_partkey} - {None}
    assert {(r.kmer, r.n, r.parts) for r in got.collect()} == {(c, n[c], len(keys[c])) for c in n}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan and "23), REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(p_partkey#\d+L, kmer", plan), plan


def test_off_target_texts_are_compiled(spark, parts):
    """Same letters as the function over an array of places, which is not compiled."""
    t = O.texts(spark, parts)
    assert "lambda" not in t._jdf.queryExecution().optimizedPlan().toString()
    base = F.translate(F.substring(F.md5("p_brand"), 1, 20), "0123456789abcdef", "ACGTACGTACGTACGT")
    place = "transform(sequence(1, 20), i -> substr('ACGT', CAST((instr('ACGT', substr(b, i, 1)) - 1 + CASE WHEN (p_partkey * i + p_size) % 9 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INT), 1))"
    plain = spark.read.parquet(f"{parts}/part.parquet").withColumn("b", base).select("p_partkey", F.when(F.col("p_size") % 17 != 3, F.array_join(F.expr(place), "")).alias("s"))
    assert sorted(map(str, t.collect())) == sorted(map(str, plain.collect()))
