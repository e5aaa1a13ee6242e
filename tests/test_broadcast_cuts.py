"""Rows of a large group find their range where they are: the cuts travel to them, not the rows to their group."""

import re

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import ordering as W


def test_rows_of_a_large_group_are_not_dealt_by_their_group(spark, monkeypatch):
    monkeypatch.setattr(W, "LARGE", 50)
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    counts = df.groupBy("g", "v").agg(F.count("*").alias("__c"))
    plan = W._ranged(counts, "v", ["g"], "__r")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter.*rightHint=\(strategy=broadcast\)", plan), plan
    got = {r.g: r.quantiles for r in W.exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"]).collect()}
    values = {g: [float(i * 7919 % 3001) for i in range(3000) if i % 2 == g] for g in (0, 1)}
    for g in (0, 1):
        assert np.allclose(got[g], np.quantile(values[g], [0.25, 0.5, 0.9]))
