"""Scans of foreign formats (SRC-*) and sinks (SNK-*). Every scan is a DataFrame plan; nothing passes the driver whole."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T


def read_titled_csv(spark: SparkSession, path: str, schema: str | T.StructType, id_col: str) -> DataFrame:
    """CSV whose first lines may be a title and a header (SRC-01, SRC-02).

    The header is the first row of a file's first block whose key is the key column's own name; whatever stands before it is
    the title. Both are told by place and name, so data rows may have empty cells anywhere, or a key that reads like the
    key column, and the file splits as any other. Cells that are no value of their column's type are NULL. A record is
    a line: a quoted line break is not supported, as it would keep the file from splitting, and raises no error.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    texts = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    lines = spark.read.text(path).select(
        F.from_csv("value", texts, {"mode": "PERMISSIVE"}).alias("r"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    header = F.col(f"r.`{id_col}`").eqNullSafe(F.lit(id_col))
    # One row a file with a header.
    headers = lines.where(header & (F.col("block") == 0)).groupBy("file").agg(F.min("line").alias("header"))
    top = (F.col("block") == 0) & F.col("header").isNotNull() & (F.col("line") <= F.col("header"))
    rows = lines.join(headers, "file", "left").where(~top)
    return rows.select(*[F.expr(f"try_cast(r.`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema.fields])


def write_titled_csv(df: DataFrame, path: str, title: str) -> None:
    """Titled CSV (SNK-01): title padded to the width and header at the top of one part file, rows in as many as the plan has."""
    head = "\n".join([title + "," * (len(df.columns) - 1), ",".join(df.columns)])
    top = df.sparkSession.createDataFrame([(head,)], "value string")
    top.unionByName(df.select(F.to_csv(F.struct(*df.columns)).alias("value"))).write.text(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated text with ``#`` comments, columns by place (SRC-04); a cell that is no value of its column's type, or is missing, is NULL."""
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="PERMISSIVE", header=False)


def clean_names(df: DataFrame) -> DataFrame:
    """Header names without a leading ``number)`` (SRC-04)."""
    return df.toDF(*[c.split(")", 1)[-1].strip() for c in df.columns])


def read_context_scores(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Headerless ``context,score`` lines split at the last comma (SRC-05)."""
    lines = spark.read.text(list(paths))
    return lines.select(F.regexp_extract("value", r"^(.*),([^,]*)$", 1).alias("context"), F.expr("try_cast(regexp_extract(value, '^(.*),([^,]*)$', 2) AS DOUBLE)").alias("score"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, bases) of every record of a FASTA file, upper case (SRC-06); files split between records."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("x")).where(F.trim("x") != "")
    body = F.upper(F.regexp_replace(F.regexp_extract("x", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", ""))
    return records.select(F.regexp_extract("x", r"^(\S*)", 1).alias("name"), body.alias("bases"))


def read_wiggle(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Dense (pos, value) of a variableStep wiggle: 0 where nothing is given, outside 1..n dropped (SRC-07)."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d+\s"))
    sparse = lines.select(F.split("value", r"\s+").alias("x")).select(F.col("x")[0].cast("long").alias("pos"), F.col("x")[1].cast("double").alias("value"))
    axis = spark.range(1, n + 1).withColumnRenamed("id", "pos")
    return axis.join(sparse.groupBy("pos").agg(F.max_by("value", F.struct("value")).alias("value")), "pos", "left").select("pos", F.coalesce("value", F.lit(0.0)).alias("value"))


def mean_tracks(tracks: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """(role, pos, value): mean of the replicates of each role (SRC-08)."""
    out = None
    for role, frames in tracks.items():
        for f in frames:
            part = f.select(F.lit(role).alias("role"), "pos", "value")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("role", "pos").agg(F.avg("value").alias("value"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a dense whitespace matrix whose first cell of a line is its row number (SRC-09)."""
    cells = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x"))
    return cells.select(F.col("x")[0].cast("long").alias("i"), F.posexplode(F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0)))).alias("j", "v")).select("i", "j", F.col("v").cast("double").alias("v"))


def read_excel(spark: SparkSession, path: str, **options) -> DataFrame:
    """A sheet by pandas on the driver (SRC-10): workbooks are small by their format; needs openpyxl or xlrd."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, **options))


def lookup_json(lookup: DataFrame) -> DataFrame:
    """(unit, json): a tidy (unit, property, kmer, value) lookup as one JSON object a unit (SRC-11, SC-19)."""
    inner = lookup.groupBy("unit", "property").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kmer", "value")))).alias("m"))
    return inner.groupBy("unit").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", F.to_json("m").alias("m")))))).alias("json"))


def lookup_rows(objects: DataFrame) -> DataFrame:
    """The tidy lookup again."""
    outer = objects.select("unit", F.explode(F.from_json("json", "map<string,string>")).alias("property", "m"))
    return outer.select("unit", "property", F.explode(F.from_json("m", "map<string,double>")).alias("kmer", "value"))


def read_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or an empty one of the schema where there is none (SRC-15)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def available(spark: SparkSession) -> list[str]:
    """Names of the tables and views at hand (SRC-14)."""
    return sorted(t.name for t in spark.catalog.listTables())


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Append rows to a Parquet table (SNK-02)."""
    df.write.mode("append").parquet(path)


def check_block(df: DataFrame, key: str, prefix: str = "eng.") -> DataFrame:
    """The block itself; ValueError for a missing or repeated key or a column without the prefix (SNK-03)."""
    if key not in df.columns:
        raise ValueError(f"block lacks {key}")
    if odd := [c for c in df.columns if c != key and not c.startswith(prefix)]:
        raise ValueError(f"columns without {prefix}: {odd}")
    if df.groupBy(key).count().where("count > 1 OR " + key + " IS NULL").limit(1).count():
        raise ValueError(f"{key} is not unique")
    return df


def write_block(df: DataFrame, path: str, key: str, prefix: str = "eng.") -> None:
    """Checked block as Parquet (SNK-03)."""
    check_block(df, key, prefix).write.mode("overwrite").parquet(path)


def write_run_metadata(spark: SparkSession, path: str, metadata: Mapping) -> None:
    """One JSON row of a run's settings (SNK-04)."""
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def numbered(df: DataFrame, order: Sequence[str], name: str = "row_idx", group: Sequence[str] = ()) -> DataFrame:
    """Row index inside groups by an explicit order: a DataFrame has no order of its own."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
