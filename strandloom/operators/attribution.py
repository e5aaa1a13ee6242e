"""Exact attribution of tree predictions to columns, by paths (ML-25).

A leaf's part in a prediction depends only on the columns cut on its path. For each of them the path keeps the share of
the training weight that passes its cuts when the column is unknown, and the interval of values that pass them. A
column's Shapley value of a leaf then is a polynomial in these shares: the product of (share + passes * y) over the other
columns of the path, its coefficients weighted by how many orders put so many columns before it (Lundberg et al., 2018,
in the form that takes whole batches at a time). Values of a row sum to its prediction less the expectation.

Paths are a small table on the side of the model; rows are explained where they are, a batch at a time, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.operators.boosting import Boosted, matrix

#: Rows of a batch that are explained at once.
BATCH_ROWS = 2048


@dataclass
class Path:
    """A leaf: its value, and for each distinct column of its path the share of weight, the interval (low, high] and
    whether missing values pass."""

    value: float
    columns: np.ndarray
    share: np.ndarray
    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray


@dataclass
class Paths:
    width: int
    base: float
    leaves: list[Path]

    @property
    def expectation(self) -> float:
        return self.base + sum(p.value * float(np.prod(p.share)) for p in self.leaves)

    def values(self, x: np.ndarray) -> np.ndarray:
        """Shapley values of every row and column."""
        phi = np.zeros((len(x), self.width))
        for p in self.leaves:
            d = len(p.columns)
            if not d or not p.value:
                continue
            own = x[:, p.columns]
            passes = np.where(np.isnan(own), p.missing, (own > p.low) & (own <= p.high))
            for k in range(d):
                poly = np.zeros((d, len(x)))
                poly[0] = 1.0
                for n, j in enumerate(j for j in range(d) if j != k):
                    shifted = poly[: n + 1] * passes[:, j]
                    poly[: n + 1] *= p.share[j]
                    poly[1 : n + 2] += shifted
                weights = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
                phi[:, p.columns[k]] += p.value * (passes[:, k] - p.share[k]) * (weights @ poly)
        return phi


def _path(value: float, cuts: Sequence[tuple[int, float, bool, bool, float]]) -> Path:
    """From the cuts (column, threshold, to the left, missing goes left, share of the weight that goes this way)."""
    columns = sorted({c[0] for c in cuts})
    share, low, high, missing = ({c: v for c in columns} for v in (1.0, -np.inf, np.inf, True))
    for c, threshold, left, missing_left, part in cuts:
        share[c] *= part
        missing[c] &= left == missing_left
        if left:
            high[c] = min(high[c], threshold)
        else:
            low[c] = max(low[c], threshold)
    return Path(value, np.array(columns, dtype=np.int64), *(np.array([d[c] for c in columns]) for d in (share, low, high, missing)))


def boosted_paths(model: Boosted, member: int) -> Paths:
    """All leaves of a member of ``boosting.fit_boosted``."""
    m, leaves = model.members[member], []
    trees = m.trees
    for t in range(m.grown):
        open_ = [(0, [])]
        while open_:
            node, cuts = open_.pop()
            c = int(trees.column[t, node])
            if c < 0:
                leaves.append(_path(float(m.scale[t] * trees.value[t, node]), cuts))
                continue
            children = (2 * node + 1, 2 * node + 2)
            total = sum(trees.cover[t, i] for i in children)
            for child, left in zip(children, (True, False)):
                open_.append((child, [*cuts, (c, float(trees.threshold[t, node]), left, bool(trees.missing_left[t, node]), float(trees.cover[t, child] / total))]))
    return Paths(len(model.cuts), m.base, leaves)


def library_paths(fitted, path: str) -> Paths:
    """All leaves of a fitted tree, forest or boosted model of the library, read from its saved nodes; ``path`` is a new folder."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    fitted.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    node = "nodeData.*" if "nodeData" in nodes.columns else "*"
    rows = nodes.select(*([F.col("treeID")] if "treeID" in nodes.columns else [F.lit(0).alias("treeID")]), node)
    # Nodes of the trees, not rows of the data.
    held: dict[int, dict[int, tuple]] = {}
    for r in rows.select("treeID", "id", "prediction", "leftChild", "rightChild", "rawCount", F.col("split.featureIndex").alias("column"), F.col("split.leftCategoriesOrThreshold").alias("at"), F.col("split.numCategories").alias("categories")).collect():
        if r.leftChild >= 0 and r.categories >= 0:
            raise ValueError("cuts by categories have no interval")
        held.setdefault(r.treeID, {})[r.id] = r
    weights = getattr(fitted, "treeWeights", [1.0])
    # A forest averages its trees, boosting sums them.
    scale = 1 / len(held) if type(fitted).__name__.startswith("RandomForest") else 1.0
    leaves = []
    for t, tree in sorted(held.items()):
        open_ = [(0, [])]
        while open_:
            i, cuts = open_.pop()
            r = tree[i]
            if r.leftChild < 0:
                leaves.append(_path(weights[t] * scale * r.prediction, cuts))
                continue
            total = tree[r.leftChild].rawCount + tree[r.rightChild].rawCount
            for child, left in ((r.leftChild, True), (r.rightChild, False)):
                open_.append((child, [*cuts, (r.column, r["at"][0], left, False, tree[child].rawCount / total)]))
    return Paths(fitted.numFeatures, 0.0, leaves)


def tree_attribution(df: DataFrame, paths: Paths) -> DataFrame:
    """(key, phi, expectation) of every row (key, features); NULL and NaN follow the trees' side for missing values."""
    expectation = paths.expectation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(s, BATCH_ROWS)
                phi = paths.values(matrix(batch.column("features"), paths.width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(phi) + 1) * paths.width, pa.int32()), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists, pa.array(np.full(len(phi), expectation))], names=["key", "phi", "expectation"])

    return df.select("key", "features").mapInArrow(run, f"key {dict(df.dtypes)['key']}, phi array<double>, expectation double")


def mean_attribution(df: DataFrame, paths: Paths, n_rows: int = 1000, seed: int = 0) -> DataFrame:
    """(pos, importance): mean size of each column's values over the ``n_rows`` rows with the least hashes of key and seed (ML-25).

    The subsample is for cost only: each of its rows is explained exactly.
    """
    drawn = df.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n_rows)  # each task keeps n_rows rows at most
    values = tree_attribution(drawn.repartition(max(1, min(n_rows // 64, df.sparkSession.sparkContext.defaultParallelism))), paths)
    return values.select(F.posexplode("phi").alias("pos", "v")).groupBy("pos").agg(F.avg(F.abs("v")).alias("importance"))
