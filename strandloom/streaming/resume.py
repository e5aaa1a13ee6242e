"""Incremental resume as a stream (STM-00): new files' rows that are not done yet are appended once."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from strandloom.operators.joins import remaining
from strandloom.sources.files import read_if_any
from strandloom.sources.workspace import work_folder


class DeadlinePassed(Exception):
    """Ends a stream before a micro-batch whose turn comes too late."""


def resume_stream(
    spark: SparkSession, source: str, schema: str, target: str, keys: Sequence[str], checkpoint: str, deadline: float | None = None,
    files_a_batch: int | None = None, clock: Callable[[], float] = time.time,
) -> bool:
    """Process what ``source`` holds and stop; a second run with the same checkpoint takes new files only.

    Each micro-batch is anti-joined with the target, so a batch that is run again after a failure appends nothing twice.
    Once the clock has passed ``deadline``, seconds since the epoch, the batch at hand is given up before it writes and left to the
    next run; ``files_a_batch`` bounds how much that is. True if all of the source was processed.
    """
    late = False

    def append(batch: DataFrame, _: int) -> None:
        nonlocal late
        if deadline is not None and clock() >= deadline:
            late = True
            raise DeadlinePassed
        todo = remaining(batch.dropDuplicates(list(keys)), read_if_any(spark, target, schema), keys)
        todo.write.mode("append").parquet(target)

    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    running = reader.parquet(source).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    except StreamingQueryException:
        if not late:
            raise
    return not late


def windowed_means(events: DataFrame, time: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """Mean and count by key and tumbling window, late rows taken up to the watermark; works on streams and tables."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "mean", "n")


def run_windowed_means(spark: SparkSession, source: str, schema: str, time: str, key: str, value: str, window: str = "1 day", late: str = "1 hour", state: str | None = None) -> DataFrame:
    """The closed windows as a table, after all that ``source`` holds.

    A window is appended once the watermark, ``late`` behind the latest time seen, has passed its end; its state ends
    there, and rows that come later are dropped. With the same ``state`` folder a second run takes new files only.
    """
    folder = state or work_folder(spark, "windows")
    out = windowed_means(spark.readStream.schema(schema).parquet(source), time, key, value, window, late)
    stream = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")
