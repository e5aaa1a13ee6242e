"""Work tables leave no shuffle files behind."""

import re
import time

from pyspark.sql import functions as F

from strandloom.llm.common import materialise


def shuffles(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return set(re.findall(r"shuffle_(\d+)_", files.mkString(" ")))


def test_a_work_table_leaves_no_shuffle_files(spark):
    known, setting = shuffles(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    counts = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n"))
    found = materialise(counts, "freed")
    until = time.time() + 10
    while shuffles(spark) - known and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - known
    assert spark.conf.get(setting) == before
    # The plan can run again.
    assert counts.join(found.withColumnRenamed("n", "m"), "k").where("n = m").count() == 97
