"""Runs that stop at a deadline and go on, as folds and as streams."""

import pytest
from pyspark.sql import functions as F

from strandloom.sources import ledger as L
from strandloom.sources.workspace import work_folder
from strandloom.streaming.resume import resume_stream


def test_stops_between_folds_and_equals_the_straight_run(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(60)], "key long, fold int, v double")
    fitted = []

    def work(f):
        fitted.append(f)
        return df.where(F.col("fold") == f).select("key", (F.col("v") * 2).alias("v"))

    now = [0.0]

    def clock():
        now[0] += 1.0
        return now[0]

    folder, straight = work_folder(spark, "run"), work_folder(spark, "run")
    some, left = L.run_folds(df, folder, work, settings={"a": 1}, deadline=2.5, clock=clock)
    assert left == [1, 2] and fitted == [0] and some.count() == 20
    now[0] = 0.0
    rows, left = L.run_folds(df.repartition(5), folder, work, settings={"a": 1}, deadline=1e9, clock=clock)
    assert left == [] and fitted == [0, 1, 2]
    whole, _ = L.run_folds(df, straight, work, settings={"a": 1})
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))
    again, left = L.run_folds(df, folder, work, settings={"a": 1})
    assert fitted == [0, 1, 2, 0, 1, 2] and again.count() == 60 and left == []
    assert sorted(map(tuple, L.verify_run(spark, folder, "key").collect())) == [(0, True), (1, True), (2, True)]
    df.where("key < 5").select("key", "v").write.mode("overwrite").parquet(f"{folder}/rows/fold=1")
    assert sorted(map(tuple, L.verify_run(spark, folder, "key").collect())) == [(0, True), (1, False), (2, True)]
    for other, settings in ((df, {"a": 2}), (df.withColumn("key", F.col("key") + 1), {"a": 1})):
        with pytest.raises(ValueError):
            L.run_folds(other, folder, work, settings=settings)


def test_no_fold_before_a_past_deadline(spark):
    df = spark.createDataFrame([(1, 0)], "key long, fold int")
    rows, left = L.run_folds(df, work_folder(spark, "run"), lambda f: df, deadline=0.0)
    assert rows.count() == 0 and left == [0]


def test_a_stream_gives_up_late_batches_and_resumes(spark):
    source, target, checkpoint = (work_folder(spark, n) for n in ("source", "target", "checkpoint"))
    for i in range(3):
        spark.createDataFrame([(i, "a"), (i, "b")], "k long, s string").coalesce(1).write.mode("append").parquet(source)
    ticks = iter([0.0, 5.0])
    assert not resume_stream(spark, source, "k long, s string", target, ["k", "s"], checkpoint, deadline=1.0, files_a_batch=1, clock=lambda: next(ticks))
    assert spark.read.parquet(target).count() == 2
    assert resume_stream(spark, source, "k long, s string", target, ["k", "s"], checkpoint)
    assert spark.read.parquet(target).count() == 6 == spark.read.parquet(target).distinct().count()
