"""Work in folds that stops at a deadline and goes on later (STM-00, ML-11, SNK-04).

A run is a folder: ``rows`` with one Parquet folder a finished fold, ``ledger`` with one row a fold (its number of rows and an
order-free digest of its keys), and ``manifest`` with the settings and the folds' digests before any work. Work stops between
folds or micro-batches once the clock has passed an absolute time; a later run with the same settings takes the folds
that the ledger lacks, and one with other settings is refused. A fold's rows are written before its ledger row, and written anew
if that row is missing, so a run lost half-way leaves nothing twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.sources.files import read_if_any

LEDGER = "fold long, n long, digest string, finished double"
MANIFEST = "fold long, n long, digest string, settings string"


def digest_of(df: DataFrame, keys: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, digest): number of rows and two sums of hashes of their keys, the same in any order and partitioning."""
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), *keys).cast("decimal(38,0)")).cast("string")
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.concat_ws(":", hashed(1), hashed(2)).alias("digest"))


def write_manifest(df: DataFrame, folder: str, key: str, fold: str, settings: Mapping) -> bool:
    """Write the folds' digests and the settings (SNK-04); False if the same manifest is there, ValueError if another one is."""
    spark = df.sparkSession
    text = json.dumps(settings, sort_keys=True)
    made = digest_of(df, [key], [fold]).select(F.col(fold).cast("long").alias("fold"), "n", "digest", F.lit(text).alias("settings"))
    held = read_if_any(spark, f"{folder}/manifest", MANIFEST)
    before = {tuple(r) for r in held.collect()}  # one row a fold
    if not before:
        made.coalesce(1).write.parquet(f"{folder}/manifest")
        return True
    if before != {tuple(r) for r in made.collect()}:
        raise ValueError(f"{folder} belongs to other folds or settings")
    return False


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger: one row a finished fold."""
    return read_if_any(spark, f"{folder}/ledger", LEDGER)


def run_folds(
    df: DataFrame, folder: str, work: Callable[[int], DataFrame], key: str = "key", fold: str = "fold", settings: Mapping | None = None,
    deadline: float | None = None, clock: Callable[[], float] = time.time,
) -> tuple[DataFrame, list[int]]:
    """(rows of all finished folds, folds left): ``work(fold)`` for each fold of ``df`` that is not in the ledger, in order.

    No fold is begun after ``deadline``, seconds since the epoch. Finished folds are not worked on again.
    """
    spark = df.sparkSession
    write_manifest(df, folder, key, fold, settings or {})
    folds = sorted(r[0] for r in df.select(F.col(fold).cast("long")).distinct().collect())
    done = {r.fold for r in finished(spark, folder).collect()}
    left = [f for f in folds if f not in done]
    schema = None
    while left and (deadline is None or clock() < deadline):
        f = left[0]
        rows = work(f)
        schema = rows.schema
        rows.write.mode("overwrite").parquet(f"{folder}/rows/fold={f}")
        entry = digest_of(spark.read.schema(schema).parquet(f"{folder}/rows/fold={f}"), [key]).select(F.lit(f).cast("long").alias("fold"), "n", "digest", F.lit(float(clock())).alias("finished"))
        entry.coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
        done.add(f)
        left.pop(0)
    paths = [f"{folder}/rows/fold={f}" for f in sorted(done)]
    if not paths:
        return spark.createDataFrame([], df.schema).limit(0), left
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths), left


def verify_run(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(fold, ok): whether the rows of each fold in the ledger still have its number and digest (ML-42)."""
    out = None
    for r in finished(spark, folder).collect():  # one row a fold
        now = digest_of(spark.read.parquet(f"{folder}/rows/fold={r.fold}"), [key])
        part = now.select(F.lit(r.fold).cast("long").alias("fold"), ((F.col("n") == r.n) & (F.col("digest") == r.digest)).alias("ok"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "fold long, ok boolean")
