"""The row bootstrap makes one digest a row and replicate."""

from pyspark.sql import functions as F

from strandloom.operators import aggregates as A


def test_one_digest_a_draw(spark, capsys):
    rows = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "key long, y double")

    out = A.row_bootstrap(rows, "key", {"mean": F.sum(F.col("w") * F.col("y")) / F.sum("w")}, 7)
    out.explain(True)
    plan = capsys.readouterr().out
    optimized = plan[plan.index("== Optimized Logical Plan ==") : plan.index("== Physical Plan ==")]
    assert 1 <= optimized.count("md5(") <= 2
    assert [(r.metric, r.point) for r in out.collect()] == [("mean", 2.0)]
