"""Embedding near-duplicates: int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 within a group; each vector keeps the length of its quantisation error. The
cosine of a pair differs from the quantised product by at most e_u + e_v + e_u * e_v, so a pair whose product plus
that bound is below the threshold is no link, one whose product less the bound reaches it is a link for certain, and
only the pairs between are computed again in double precision.

Exact copies are combined first. The distinct vectors are dealt by a hash into groups of about GROUP_ROWS; a cell
of the triangular grid of groups compares two groups, so every pair of vectors meets in exactly one cell and no
task holds more than two groups. A cell gives, for each vector, its number of links and one link of a spanning
forest; pairs are never emitted. Counts are summed per vector, components come from ``graph.py``.

The products of all tiles grow with the square of the distinct vectors, as the method implies; each vector is sent
to as many cells as there are groups.

Defined cases: a vector that is null, zero, empty or holds a null or non-finite component has no links and is its
own component; vectors of different lengths do not link; ``component_id`` is the smallest non-null id reachable,
``kept`` is false for a null id; repeated rows count as other vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import map_columns, materialise, ship_package
from strandloom.llm.graph import Forest, connected_components

#: Distinct vectors a group, at most and at least.
GROUP_ROWS, LEAST_ROWS = 8192, 1024
#: Rows of a product's left side.
BLOCK = 512
#: Covers the rounding of double arithmetic on unit vectors.
SLACK = 1e-9


def _precision(vectors: DataFrame, vector_col: str) -> str:
    """Four bytes a component where the column has no more; all arithmetic is in double precision."""
    return "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"


def _keys(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key): the vector's bytes in its own precision, null where it links with nothing."""
    dtype = _precision(vectors, vector_col)

    def run(column: pa.Array) -> list[pa.Array]:
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0
        ends = np.cumsum(lengths)
        starts = ends - lengths
        odd, filled = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(values), values != 0))
        usable = (odd[ends] == odd[starts]) & (filled[ends] > filled[starts])
        values = values.astype(dtype)
        keys = [values[s:e].tobytes() if ok else None for s, e, ok in zip(starts.tolist(), ends.tolist(), usable.tolist())]
        return [pa.array(keys, pa.binary())]

    return map_columns(vectors, run, [T.StructField("__key", T.BinaryType())], [vector_col], [id_col])


def quantise(units: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 values, their common scale and the length of every row's error."""
    scale = max(float(np.abs(units).max(initial=0.0)), 1e-300) / 127.0
    q = np.rint(units / scale)
    return q.astype(np.int8), scale, np.sqrt(((units - q * scale) ** 2).sum(axis=1)) + SLACK


def compare(keys: list[bytes], first: np.ndarray, copies: np.ndarray, threshold: float, same: bool, dtype: str = "<f8") -> tuple[np.ndarray, Forest]:
    """Links of every row (copies counted) and the forest of a cell; ``first`` marks the left group's rows, ``same`` a
    group with itself. A group may hold no vector of this length, so that cannot be told from the rows."""
    x = np.stack([np.frombuffer(k, dtype=dtype) for k in keys]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    units = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    q, scale, error = quantise(units)
    # Sums of int8 products are whole numbers that float32 holds exactly up to 2^24.
    q = q.astype(np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64)
    ours = np.flatnonzero(first)
    theirs = ours if same else np.flatnonzero(~first)
    links, forest = np.zeros(len(keys)), Forest(len(keys))
    if not len(ours) or not len(theirs):
        return links, forest
    widest = float(error[theirs].max())
    for s in range(0, len(ours), BLOCK):
        left, right = ours[s : s + BLOCK], theirs[s:] if same else theirs
        product = q[left] @ q[right].T
        loosest = float(error[left].max())
        i, j = np.nonzero(product >= (threshold - loosest - widest - loosest * widest) / scale**2)
        a, b = left[i], right[j]
        near = product[i, j].astype(np.float64) * scale**2
        bound = error[a] + error[b] + error[a] * error[b]
        possible = (near + bound >= threshold) & (a < b if same else True)
        a, b, certain = a[possible], b[possible], (near - bound >= threshold)[possible]
        open_ = np.flatnonzero(~certain)
        for t in range(0, len(open_), 65_536):
            part = open_[t : t + 65_536]
            certain[part] = np.einsum("ij,ij->i", units[a[part]], units[b[part]]) >= threshold
        a, b = a[certain], b[certain]
        links += np.bincount(a, weights=copies[b], minlength=len(keys)) + np.bincount(b, weights=copies[a], minlength=len(keys))
        forest.link(a, b)
    return links, forest


def embedding_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    ship_package(spark)
    dtype = _precision(vectors, vector_col)
    marked = materialise(_keys(vectors, id_col, vector_col), "vectors")
    distinct = materialise(
        marked.where("__key IS NOT NULL").groupBy("__key")
        .agg(F.count("*").alias("copies"), F.min(F.col(f"`{id_col}`")).alias("low"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "distinct",
    )
    # Smaller groups where else there were fewer cells than cores.
    n, cores = distinct.count(), spark.sparkContext.defaultParallelism
    groups = max(1, -(-n // GROUP_ROWS), min(-(-n // LEAST_ROWS), math.ceil(math.sqrt(4 * cores))))
    group = F.pmod(F.xxhash64("__key"), F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    cells = (
        distinct.select("__key", "copies", "rid", F.length("__key").alias("dim"), group.alias("g"))
        .withColumn("h", other)
        .select("__key", "copies", "rid", "dim", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), (F.col("g") <= F.col("h")).alias("first"))
    )

    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        rid = table.column("rid").to_numpy()
        same = table.column("a")[0] == table.column("b")[0]
        links, forest = compare(table.column("__key").to_pylist(), first, table.column("copies").to_numpy().astype(float), threshold, same, dtype)
        linked = np.flatnonzero(links)
        return pa.table(
            {"rid": pa.array(rid[linked], pa.int64()), "links": pa.array(links[linked].astype(np.int64)), "root": pa.array(rid[forest.label[linked]], pa.int64())}
        )

    found = materialise(cells.groupBy("dim", "a", "b").applyInArrow(run, "rid long, links long, root long"), "near")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rid").alias("src"), F.col("root").alias("dst")))
    placed = (
        distinct.join(counts, "rid", "left").join(parts.withColumnRenamed("node", "rid"), "rid", "left")
        .select("__key", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("root"))
    )
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    per_key = materialise(placed.join(lows, "root").select("__key", "n_links", "component_id"), "placed")
    joined = marked.join(per_key, "__key", "left")
    component = F.when(F.col("__key").isNull(), F.col(f"`{id_col}`")).otherwise(F.col("component_id"))
    return joined.select(
        F.col(f"`{id_col}`"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(F.col(f"`{id_col}`") == component, F.lit(False)).alias("kept"),
    )
