"""Regressors beyond the library's own (ML-16): partial least squares, nearest neighbours, random kernel features.

Rows are (key, fold, label, features array<double>); every model is fitted outside the fold it predicts. Columns are
standardised with the training rows' mean and deviation first; all folds' sums come from one pass each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.block_matrix import ridge_predictions
from strandloom.operators.boosting import matrix
from strandloom.sources.workspace import stored

#: Rows of a tile of the nearest-neighbour search at least and at most; rows multiplied at once.
TILE, LARGE_TILE, SLICE_ROWS = 2048, 16_384, 4096
#: Columns of a block of the kernel features' matrix: 2 MB.
KERNEL_BLOCK = 512


def _width(df: DataFrame) -> int:
    return df.select(F.max(F.size("features"))).first()[0] or 0


def _rows(df: DataFrame) -> DataFrame:
    return df.select("key", F.col("fold").cast("long").alias("fold"), F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features"))


def fold_moments(df: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Fold -> (rows, label sum, column sums, column squares) of the fold; one row a fold and column in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x, folds, y = matrix(batch.column("features"), width), batch.column("fold").to_numpy(), batch.column("label").to_numpy()
            for f in np.unique(folds).tolist():
                own = x[folds == f]
                found = np.concatenate([[len(own), y[folds == f].sum()], own.sum(axis=0), (own * own).sum(axis=0)])
                held[f] = held[f] + found if f in held else found
        yield pa.RecordBatch.from_pydict({"fold": pa.array([f for f in held for _ in held[f]], pa.int64()), "j": pa.array([j for f in held for j in range(len(held[f]))], pa.int64()), "v": pa.array([v for f in held for v in held[f].tolist()], pa.float64())})

    sums = _rows(df).mapInArrow(run, "fold long, j long, v double").groupBy("fold", "j").agg(F.sum("v").alias("v")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sums:
        out.setdefault(r.fold, np.zeros(2 * width + 2))[r.j] = r.v
    return out


def scales(moments: dict[int, np.ndarray], width: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Fold -> (mean, deviation, label mean) of the rows outside it; a constant column has the deviation 1."""
    total, out = sum(moments.values()), {}
    for f, own in moments.items():
        rest = total - own
        n = max(rest[0], 1.0)
        mean = rest[2 : 2 + width] / n
        sd = np.sqrt(np.maximum(rest[2 + width :] / n - mean**2, 0.0))
        out[f] = (mean, np.where(sd > 1e-12, sd, 1.0), rest[1] / n)
    return out


def _predicted(df: DataFrame, width: int, value) -> DataFrame:
    """(key, fold, label, prediction) by ``value(fold, features)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, folds = matrix(batch.column("features"), width), batch.column("fold").to_numpy()
            made = np.zeros(len(folds))
            for f in np.unique(folds).tolist():
                made[folds == f] = value(f, x[folds == f])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "fold", "label")], pa.array(made)], names=["key", "fold", "label", "prediction"])

    return _rows(df).mapInArrow(run, f"key {dict(df.dtypes)['key']}, fold long, label double, prediction double")


def pls_predictions(df: DataFrame, components: int = 25) -> DataFrame:
    """Partial least squares with one label, out of fold.

    A component is the direction w of X'y left after those before; its scores t = X w need a pass for t't and X't. Instead of
    deflating rows, the directions are made orthogonal against the loadings of the components before, which gives the same
    scores. A component's weight comes from the X'y left, not from y: once nothing but rounding is left of it, directions are
    noise, and their scores are no longer orthogonal to those before. A pass sums all folds at once: folds times columns numbers.
    """
    width = _width(df)
    rows = stored(_rows(df), "pls-rows")
    scale = scales(fold_moments(rows, width), width)
    folds = sorted(scale)

    def passed(weights: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        """Fold -> sums over the rows outside it: X'y, or X't and t't of the scores t = X w."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {f: np.zeros(width + 1) for f in folds}
            for batch in batches:
                x, own, y = matrix(batch.column("features"), width), batch.column("fold").to_numpy(), batch.column("label").to_numpy()
                for f in folds:
                    out = own != f
                    z, v = (x[out] - scale[f][0]) / scale[f][1], y[out] - scale[f][2]
                    t = v if weights is None else z @ weights[f]
                    sums[f] += np.concatenate([z.T @ t, [t @ t]])
            yield pa.RecordBatch.from_pydict({"fold": np.repeat(folds, width + 1), "j": np.tile(np.arange(width + 1), len(folds)), "v": np.concatenate([sums[f] for f in folds]) if folds else np.zeros(0)})

        found = {f: np.zeros(width + 1) for f in folds}
        for r in rows.mapInArrow(run, "fold long, j long, v double").groupBy("fold", "j").agg(F.sum("v").alias("v")).collect():
            found[r.fold][r.j] = r.v
        return found

    left = {f: s[:width].copy() for f, s in passed(None).items()}  # X'y less what is explained
    beta, loadings, directions = {f: np.zeros(width) for f in folds}, {f: [] for f in folds}, {f: [] for f in folds}
    for _ in range(min(components, width)):
        turned = {}
        for f in folds:
            w = left[f] / max(np.linalg.norm(left[f]), 1e-300)
            # r = w less its parts along earlier directions, so that X r is the score of the deflated X.
            for p, r in zip(loadings[f], directions[f]):
                w = w - (p @ w) * r
            turned[f] = w
        sums = passed(turned)
        for f in folds:
            tt, ty = sums[f][width], turned[f] @ left[f]
            if tt <= 1e-12:
                loadings[f].append(np.zeros(width))
                directions[f].append(np.zeros(width))
                continue
            p, q = sums[f][:width] / tt, ty / tt
            beta[f] = beta[f] + q * turned[f]
            left[f] = left[f] - q * sums[f][:width]
            loadings[f].append(p)
            directions[f].append(turned[f])
    return _predicted(df, width, lambda f, x: scale[f][2] + (x - scale[f][0]) / scale[f][1] @ beta[f])


def nearest(square: np.ndarray, k: int) -> np.ndarray:
    """Places of every row's k least values in their order, equal values by place; only those and their equals are sorted."""
    if square.shape[1] <= k:
        return np.argsort(square, axis=1, kind="stable")
    most = np.partition(square, k - 1, axis=1)[:, k - 1 : k]
    row, at = np.nonzero(square <= most)
    order = np.lexsort((at, square[row, at], row))
    counts = np.bincount(row, minlength=len(square))
    starts = np.cumsum(counts) - counts
    return at[order][starts[:, None] + np.arange(k)]


def knn_predictions(df: DataFrame, k: int = 50, tile: int | None = None) -> DataFrame:
    """Mean label of the k nearest rows outside the fold, weighted by 1 / distance; rows at distance 0 alone where there are any.

    Rows are dealt into tiles; a pair of tiles is one bounded task that sends k candidates a row, never its pairs. The products
    grow with the square of the rows, as the method asks, and so do the copies sent, by the rows a tile. Equal distances go to
    the lesser key.
    """
    width = _width(df)
    rows = stored(_rows(df), "knn-rows")
    scale = scales(fold_moments(rows, width), width)
    n = rows.count()
    tile = tile or min(LARGE_TILE, max(TILE, -(-n // 4)))
    tiles = max(1, -(-n // tile))
    dealt = rows.withColumn("a", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int"))
    asked = dealt.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("asks", F.lit(True))
    given = dealt.withColumnRenamed("a", "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("asks", F.lit(False))
    kind = dict(df.dtypes)["key"]

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        x, folds, label = matrix(table.column("features").combine_chunks(), width), table.column("fold").to_numpy(), table.column("label").to_numpy()
        ours, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        theirs = theirs[np.argsort(np.array(table.column("key").take(pa.array(theirs)).to_pylist(), dtype=object), kind="stable")] if len(theirs) else theirs
        out = []
        for f in np.unique(folds[ours]).tolist():
            mine, others = ours[folds[ours] == f], theirs[folds[theirs] != f]
            if not len(others):
                continue
            z = (x[others] - scale[f][0]) / scale[f][1]
            for s in range(0, len(mine), 256):
                q = mine[s : s + 256]
                u = (x[q] - scale[f][0]) / scale[f][1]
                square = np.maximum((u * u).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None, :] - 2 * u @ z.T, 0.0)
                at = nearest(square, k)
                # The few kept again by difference, which keeps equal rows at distance 0.
                near = np.sqrt(((u[:, None, :] - z[at]) ** 2).sum(axis=2))
                out.append((np.repeat(q, at.shape[1]), others[at].ravel(), near.ravel()))
        q, o, d = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, dtype=np.int64) for i in range(3))
        names = table.column("key")
        return pa.table({"key": names.take(pa.array(q, pa.int64())), "other": names.take(pa.array(o, pa.int64())), "d": pa.array(d, pa.float64()), "v": pa.array(label[o.astype(np.int64)], pa.float64())})

    columns = ["a", "b", "asks", "key", "fold", "label", "features"]
    # An explicit number of partitions, which is not coalesced: a pair of tiles or few a task.
    dealt_pairs = asked.select(*columns).unionByName(given.select(*columns)).repartition(min(tiles * tiles, 4096), "a", "b")
    found = dealt_pairs.groupBy("a", "b").applyInArrow(run, f"key {kind}, other {kind}, d double, v double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("d", "other"))).where(F.col("n") <= k)  # k a tile
    exact, weight = F.count_if(F.col("d") == 0), F.try_divide(F.lit(1.0), F.col("d"))
    value = F.when(exact > 0, F.avg(F.when(F.col("d") == 0, F.col("v")))).otherwise(F.try_divide(F.sum(weight * F.col("v")), F.sum(weight)))
    return rows.select("key", "fold", "label").join(best.groupBy("key").agg(value.alias("prediction")), "key", "left")


def cosines(width: int, features: int, gamma: float, scale: dict, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Makes ``features`` random cosines of a row, whose products tend to exp(-gamma d^2)."""
    rng = np.random.default_rng(seed)
    turns, shift = rng.normal(0, math.sqrt(2 * gamma), (width, features)), rng.uniform(0, 2 * math.pi, features)
    mean, sd = scale["mean"], scale["sd"]
    return lambda x: math.sqrt(2 / features) * np.cos((x - mean) / sd @ turns + shift)


def kernel_features(df: DataFrame, width: int, features: int, gamma: float, scale: dict, seed: int) -> DataFrame:
    """Rows once a held-out fold's scale is theirs to use, with their ``cosines`` as features."""
    lifted = cosines(width, features, gamma, scale, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(s, SLICE_ROWS)
                made = lifted(matrix(batch.column("features"), width))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * features, pa.int32()), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "fold", "label")], lists], names=["key", "fold", "label", "features"])

    return _rows(df).mapInArrow(run, f"key {dict(df.dtypes)['key']}, fold long, label double, features array<double>")


def kernel_predictions(df: DataFrame, features: int = 800, gamma: float | None = None, penalty: float = 1.0, seed: int = 0) -> DataFrame:
    """Ridge regression on random kernel features (Rahimi and Recht, 2007), out of fold; gamma is 1 / columns unless given.

    The scale of the columns is that of all rows, which no label enters; the regression itself never sees the fold. The features
    are made in the tasks that multiply them, and never written.
    """
    width = _width(df)
    rows = stored(_rows(df), "kernel-rows")
    total = sum(fold_moments(rows, width).values(), np.zeros(2 * width + 2))
    n = max(total[0], 1.0)
    mean = total[2 : 2 + width] / n
    sd = np.sqrt(np.maximum(total[2 + width :] / n - mean**2, 0.0))
    scale = {"mean": mean, "sd": np.where(sd > 1e-12, sd, 1.0)}
    return ridge_predictions(rows, penalty, KERNEL_BLOCK, (features, cosines(width, features, gamma or 1 / max(width, 1), scale, seed)))
