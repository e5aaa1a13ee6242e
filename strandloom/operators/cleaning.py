"""Projections, predicates and cleaning (PRJ-*, ST-04, AG-34, AG-40). NULL is the only missing value."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.operators.ordering import exact_quantiles


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles, NULL where a value is no number (PRJ-01)."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) if c in columns else F.col(c) for c in df.columns])


def nonfinite_to_null(c: Column) -> Column:
    """NaN and infinities as NULL (PRJ-06)."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def drop_missing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows whose required columns are all present (PRJ-02)."""
    return df.dropna(subset=list(required))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are NULL in every row, found in one pass (PRJ-04)."""
    present = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if present[c]])


def require_columns(df: DataFrame, required: Sequence[str], budget: int | None = None) -> DataFrame:
    """The frame itself; ValueError where columns are missing or fewer than ``budget`` remain (PRJ-05)."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if budget is not None and len(df.columns) - len(required) < budget:
        raise ValueError(f"{len(df.columns) - len(required)} feature columns; {budget} needed")
    return df


def select_columns(df: DataFrame, key: str, prefix: str = "", infix: str = "") -> DataFrame:
    """The key and the columns whose names have the prefix and the infix (PRJ-07)."""
    return df.select(key, *[c for c in df.columns if c != key and c.startswith(prefix) and infix in c])


def parse_identifier(c: Column) -> Column:
    """Struct of gene, locus number, offset and nuclease of ``<gene><b-number>_<offset>_<nuclease>``; NULL if unlike it (PRJ-09)."""
    pattern = r"^(.*?)([bB]\d+)_(\d+)_(.+)$"
    part = lambda k: F.regexp_extract(c, pattern, k)
    return F.when(
        c.rlike(pattern),
        F.struct(F.nullif(part(1), F.lit("")).alias("gene"), F.lower(part(2)).alias("locus"), part(3).cast("long").alias("offset"), part(4).alias("nuclease")),
    )


def parse_property_column(c: Column) -> Column:
    """Struct of position, unit, property and value name of ``p<position><unit>.<property>.<rest>``; NULL otherwise (PRJ-08)."""
    pattern = r"^p(\d+)(monomer|dimer|trimer|tetramer)\.(.+?)(raw)?$"
    part = lambda k: F.regexp_extract(c, pattern, k)
    return F.when(c.rlike(pattern), F.struct(part(1).cast("int").alias("position"), part(2).alias("unit"), part(3).alias("property")))


# The units of a property's name and how many letters each spans.
UNIT_SPANS = {"monomer": 1, "basepair": 1, "dimer": 2, "trimer": 3, "tetramer": 4}


def parse_unit_column(c: Column) -> Column:
    """Struct of position, unit, property and span of ``p<position><unit>.<property>``, the unit in any case and the property
    whole; NULL for other units and names (PRJ-08)."""
    pattern = r"^p(\d+)([A-Za-z]+)\.(.+)$"
    spans = F.create_map(*[F.lit(x) for kv in UNIT_SPANS.items() for x in kv])
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    found = F.struct(F.regexp_extract(c, pattern, 1).cast("int").alias("position"), unit.alias("unit"), F.regexp_extract(c, pattern, 3).alias("property"), F.try_element_at(spans, unit).alias("span"))
    return F.when(c.rlike(pattern) & F.try_element_at(spans, unit).isNotNull(), found)


def column_position(c: Column, last: int = 20) -> Column:
    """Position of a name with an explicit ``p<position>`` in front, in any case and from 1 to ``last``; NULL otherwise (PRJ-08)."""
    pattern = r"^[pP](\d+)(?=[A-Za-z_.]|$)"
    position = F.regexp_extract(c, pattern, 1).try_cast("int")
    return F.when(c.rlike(pattern) & position.between(1, last), position)


def first_match(c: Column, ladder: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that matches (PRJ-10)."""
    out = F.lit(default)
    for pattern, label in reversed(ladder):
        out = F.when(c.rlike(pattern), label).otherwise(out)
    return out


def modal_length(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text has the most frequent length, the smallest of tied ones (PRJ-12, AG-08)."""
    mode = df.groupBy(F.length(column).alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return df.join(F.broadcast(mode.select("n")), F.length(column) == F.col("n")).drop("n")  # one row


def above_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows at or above the exact linear quantile (PRJ-13)."""
    cut = exact_quantiles(df, column, [q]).select(F.col("quantiles")[0].alias("__cut"))
    return df.join(F.broadcast(cut), F.col(column) >= F.col("__cut")).drop("__cut")  # one row


def large_strata(df: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows (PRJ-14)."""
    held = df.groupBy(group).count().where(F.col("count") >= least).select(group)
    return df.join(held, group, "left_semi")


def one_hot(c: Column, prefix: str, categories: Sequence[str]) -> list[Column]:
    """A column of 0 and 1 for each category in order, 0 for NULL (PRJ-16)."""
    return [F.coalesce((c == F.lit(k)).cast("int"), F.lit(0)).alias(f"{prefix}{k}") for k in categories]


def recode(c: Column, mapping: Mapping[str, object], default: object = None) -> Column:
    """Value of the mapping, ``default`` for the rest (PRJ-17)."""
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def schema_fingerprint(names: Sequence[str]) -> str:
    """SHA-256 of the compact JSON list of names; their order counts (PRJ-18)."""
    return hashlib.sha256(json.dumps(list(names), separators=(",", ":")).encode()).hexdigest()


def file_fingerprints(spark, path: str) -> DataFrame:
    """(path, sha256) of whole files (PRJ-19)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def best_offset(df: DataFrame, column: str, motif: str, offsets: Sequence[int], least: float) -> DataFrame:
    """(offset, share): the offset at which most texts hold the motif, the earliest of ties, if the share suffices (PRJ-20)."""
    spread = df.select(F.col(column).alias("s"), F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    hit = (F.substr("s", F.col("offset") + 1, F.lit(len(motif))) == motif).cast("double")
    return spread.groupBy("offset").agg(F.avg(hit).alias("share")).orderBy(F.desc("share"), "offset").limit(1).where(F.col("share") >= least)


def reorder(df: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """Rows for an external list (key, ord), NULL where the key is missing (ST-04)."""
    return order.join(df, key, "left")


def fill_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, filled, distinct) of columns; constant and empty ones show (AG-34)."""
    stats = F.array(*[F.struct(F.lit(c).alias("name"), F.count(c).alias("filled"), F.count_distinct(F.col(c)).alias("distinct")) for c in columns])
    return df.agg(stats.alias("s")).select(F.inline("s"))


def agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, atol: float = 1e-6, rtol: float = 1e-5) -> DataFrame:
    """Cells present in both tidy tables and the share that agrees (AG-40)."""
    x = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), list(keys)).where("x IS NOT NULL AND y IS NOT NULL")
    return x.agg(F.count("*").alias("cells"), F.avg((F.abs(F.col("x") - F.col("y")) <= atol + rtol * F.abs("y")).cast("double")).alias("share"))


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without those of the columns that the frame has, names taken as they are, dots included (PRJ-03)."""
    unwanted = set(names)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in unwanted])
