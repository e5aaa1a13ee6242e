"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``; columns and filters are pruned at the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
