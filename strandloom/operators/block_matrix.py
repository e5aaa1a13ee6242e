"""Ridge regression of many targets on many columns by block matrices (AG-33, ML-31).

A matrix is a table of blocks (fold, i, j, block), a block a binary of doubles; none is ever whole in a task or on the driver.
Tasks multiply their rows block by block, fold by fold, and send one row a block; these are summed in two steps, so no group
grows with the tasks. A fold's normal equations are the total less the fold's own. They are factored by a right-looking
block Cholesky, all folds and all targets at once: the targets are one more block row, whose forward substitution is
part of the factorisation. Each step has a column of blocks of one fold in a task at most.

The intercept is a last column of ones and not penalised. Missing targets are filled with the mean of the training rows, and do
not count in the score. Features that are NULL or NaN are an error of the caller; fill them first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.operators.boosting import matrix
from strandloom.sources.workspace import stored

#: Columns of a block; parts that partial sums are dealt into; bytes of coefficients sent about at once.
WIDTH, PARTS, SENT_BYTES = 128, 64, 64 << 20
#: Rows multiplied at once.
SLICE_ROWS = 4096
#: Number of features that a function makes of a row's, and the function of their matrix.
Lift = tuple[int, Callable[[np.ndarray], np.ndarray]]


def _doubles(block: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(block, dtype="<f8").reshape(-1, columns)


def _spans(columns: int, width: int) -> list[tuple[int, int]]:
    return [(s, min(s + width, columns)) for s in range(0, columns, width)]


def _lifted(batch: pa.RecordBatch, features: int, lift: Lift | None) -> np.ndarray:
    """Rows of [features, 1], the features as ``lift`` makes them."""
    x = matrix(batch.column("features"), features)
    return np.hstack([x if lift is None else lift[1](x), np.ones((batch.num_rows, 1))])


def _products(rows: DataFrame, features: int, targets: int, width: int, lift: Lift | None = None) -> DataFrame:
    """(fold, i, j, block): sums of products of column blocks i >= j of [features, 1] by fold; the block row after the last
    holds the targets' sums with each column block, then the same for missing targets, then targets' sums and numbers."""
    spans = _spans((lift[0] if lift else features) + 1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        held: dict[tuple[int, int], np.ndarray] = {}
        now = None

        def out() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_pydict(
                {"fold": pa.array([now] * len(keys), pa.int64()), "i": pa.array([i for i, _ in keys], pa.int32()), "j": pa.array([j for _, j in keys], pa.int32()),
                 "part": pa.array([part] * len(keys), pa.int32()), "block": pa.array([held[k].tobytes() for k in keys], pa.binary())}
            )

        for whole in batches:
            for s in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(s, SLICE_ROWS)
                folds = batch.column("fold").to_numpy()
                part = batch.column("part")[0].as_py()
                x = _lifted(batch, features, lift)
                y = matrix(batch.column("targets"), targets)
                for f in np.unique(folds).tolist():  # rows come sorted by fold
                    if f != now:
                        if held:
                            yield out()
                        held, now = {}, f
                    a, t = x[folds == f], y[folds == f]
                    known = np.isfinite(t)
                    t = np.where(known, t, 0.0)
                    ends = np.concatenate([t.sum(axis=0), known.sum(axis=0)])
                    for j, (c, d) in enumerate(spans):
                        own = a[:, c:d]
                        for i, (c2, d2) in enumerate(spans[j:], j):
                            found = a[:, c2:d2].T @ own
                            held[i, j] = held[i, j] + found if (i, j) in held else found
                        found = np.concatenate([(t.T @ own).ravel(), ((~known).T.astype(float) @ own).ravel(), ends])
                        held[len(spans), j] = held[len(spans), j] + found if (len(spans), j) in held else found
        if held:
            yield out()

    named = rows.select(F.col("fold").cast("long").alias("fold"), F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"), "features", "targets").sortWithinPartitions("fold")
    return named.mapInArrow(run, "fold long, i int, j int, part int, block binary")


def _added(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of equal keys summed."""

    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype="<f8") for b in table.column("block").to_pylist())
        return table.slice(0, 1).select(list(keys)).append_column("block", pa.array([total.tobytes()], pa.binary()))

    kinds = dict(blocks.dtypes)
    return blocks.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", block binary")


def _normal_equations(sums: DataFrame, features: int, targets: int, width: int, penalty: float) -> DataFrame:
    """(fold, i, j, block) of the rows outside each fold, with the penalty and the filled targets."""
    spans = _spans(features + 1, width)

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        own = [np.frombuffer(b, dtype="<f8") for b in table.column("block").to_pylist()]
        total, out = sum(own), []
        for block in own:
            rest = total - block
            if i == len(spans):
                size = targets * (spans[j][1] - spans[j][0])
                known, missing, ends = rest[:size].reshape(targets, -1), rest[size : 2 * size].reshape(targets, -1), rest[2 * size :]
                mean = np.divide(ends[:targets], ends[targets:], out=np.zeros(targets), where=ends[targets:] > 0)
                rest = (known + mean[:, None] * missing).ravel()
            elif i == j:
                square = rest.reshape(spans[i][1] - spans[i][0], -1).copy()
                square[np.diag_indices(len(square))] += [penalty if c < features else 0.0 for c in range(*spans[i])]
                rest = square.ravel()
            out.append(rest.tobytes())
        return table.select(["fold", "i", "j"]).append_column("block", pa.array(out, pa.binary()))

    return sums.groupBy("i", "j").applyInArrow(run, "fold long, i int, j int, block binary")


def _panel(k: int, spans: Sequence[tuple[int, int]]):
    """The factor's column k of one fold, from that column of what is left of the matrix."""

    def run(table: pa.Table) -> pa.Table:
        width = spans[k][1] - spans[k][0]
        rows = dict(zip(table.column("i").to_pylist(), table.column("block").to_pylist()))
        corner = np.linalg.cholesky(_doubles(rows[k], width))
        out = [(corner if i == k else np.linalg.solve(corner, _doubles(b, width).T).T) for i, b in rows.items()]
        ids = {"fold": table.column("fold"), "i": pa.array(list(rows), pa.int32()), "j": pa.array([k] * len(rows), pa.int32())}
        return pa.table(ids | {"block": pa.array([np.ascontiguousarray(b).tobytes() for b in out], pa.binary())})

    return run


def _updated(left: DataFrame, panel: DataFrame, spans: Sequence[tuple[int, int]], k: int) -> DataFrame:
    """What is left of the matrix after column k: each block less the product of the panel's blocks of its row and its column."""
    width = spans[k][1] - spans[k][0]
    below = panel.where(F.col("i") > k)
    one = below.select("fold", "i", F.col("block").alias("l"))
    two = below.where(F.col("i") < len(spans)).select("fold", F.col("i").alias("j"), F.col("block").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for b, l, r in zip(*(batch.column(c).to_pylist() for c in ("block", "l", "r"))):
                x = _doubles(l, width) @ _doubles(r, width).T
                made.append((np.frombuffer(b, dtype="<f8").reshape(x.shape) - x).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("fold", "i", "j")], pa.array(made, pa.binary())], names=["fold", "i", "j", "block"])

    return left.where(F.col("j") > k).join(one, ["fold", "i"]).join(two, ["fold", "j"]).select("fold", "i", "j", "block", "l", "r").mapInArrow(run, "fold long, i int, j int, block binary")


def _solved(panel: DataFrame, known: DataFrame | None, k: int, spans: Sequence[tuple[int, int]], targets: int) -> DataFrame:
    """(fold, k, block): the coefficients of column block k, targets by columns, from those of the blocks behind it."""
    width = spans[k][1] - spans[k][0]

    def run(column: pa.Table, later: pa.Table) -> pa.Table:
        rows = dict(zip(column.column("i").to_pylist(), column.column("block").to_pylist()))
        right = _doubles(rows[len(spans)], width).copy()
        for i, b in zip(later.column("k").to_pylist(), later.column("block").to_pylist()):
            right -= _doubles(b, spans[i][1] - spans[i][0]) @ _doubles(rows[i], width)
        beta = np.linalg.solve(_doubles(rows[k], width).T, right.T).T
        return pa.table({"fold": column.column("fold").slice(0, 1), "k": pa.array([k], pa.int32()), "block": pa.array([np.ascontiguousarray(beta).tobytes()], pa.binary())})

    if known is None:
        known = panel.sparkSession.createDataFrame([], "fold long, k int, block binary")
    return panel.groupBy("fold").cogroup(known.groupBy("fold")).applyInArrow(run, "fold long, k int, block binary")


def ridge_coefficients(rows: DataFrame, features: int, targets: int, penalty: float = 1.0, width: int = WIDTH, lift: Lift | None = None) -> DataFrame:
    """(fold, k, block): coefficients fitted outside each fold, a block of ``targets`` by the columns of block k of [features, 1].

    From rows (fold, features array<double>, targets array<double>); of what ``lift`` makes of their features where it is given.
    """
    made = lift[0] if lift else features
    spans = _spans(made + 1, width)
    partial = _added(_products(rows, features, targets, width, lift), ["fold", "i", "j", "part"])
    left = stored(_normal_equations(_added(partial, ["fold", "i", "j"]), made, targets, width, penalty), "normal-equations")
    panels = []
    for k in range(len(spans)):
        panels.append(stored(left.where(F.col("j") == k).groupBy("fold").applyInArrow(_panel(k, spans), "fold long, i int, j int, block binary"), "factor"))
        if k + 1 < len(spans):
            left = stored(_updated(left, panels[-1], spans, k), "left")
    known = None
    for k in range(len(spans) - 1, -1, -1):
        found = stored(_solved(panels[k], known, k, spans, targets), "coefficients")
        known = found if known is None else known.unionByName(found)
    return known


def _by_fold(coefficients: DataFrame, targets: int) -> dict[int, np.ndarray]:
    """Fold -> columns by targets. Folds times columns times targets numbers, whatever the rows; see ``target_groups``."""
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in coefficients.collect():
        parts.setdefault(r.fold, []).append((r.k, np.frombuffer(r.block, dtype="<f8").reshape(targets, -1)))
    return {f: np.hstack([b for _, b in sorted(p, key=lambda x: x[0])]).T for f, p in parts.items()}


def target_groups(features: int, targets: int, folds: int) -> list[tuple[int, int]]:
    """Ranges of targets whose coefficients fit into SENT_BYTES."""
    size = max(1, SENT_BYTES // (8 * (features + 1) * max(folds, 1)))
    return _spans(targets, size)


def ridge_predictions(df: DataFrame, penalty: float = 1.0, width: int = WIDTH, lift: Lift | None = None) -> DataFrame:
    """(key, fold, label, prediction) by ridge regression fitted outside each row's fold; rows (key, fold, label, features)."""
    features = df.select(F.max(F.size("features"))).first()[0] or 0
    rows = df.select("key", F.col("fold").cast("long").alias("fold"), F.col("label").cast("double").alias("label"), F.col("features").cast("array<double>").alias("features"))
    shared = df.sparkSession.sparkContext.broadcast(_by_fold(ridge_coefficients(rows.withColumn("targets", F.array("label")), features, 1, penalty, width, lift), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(s, SLICE_ROWS)
                x, folds = _lifted(batch, features, lift), batch.column("fold").to_numpy()
                made = np.zeros(batch.num_rows)
                for f in np.unique(folds).tolist():
                    made[folds == f] = x[folds == f] @ shared.value[f][:, 0]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "fold", "label")], pa.array(made)], names=["key", "fold", "label", "prediction"])

    return rows.mapInArrow(run, f"key {dict(df.dtypes)['key']}, fold long, label double, prediction double")


def redundancy(df: DataFrame, penalty: float = 1.0, least: int = 200, width: int = WIDTH) -> DataFrame:
    """(target, n, r2): how much of each target the features tell, out of fold; rows (fold, features, targets) (ML-31, AG-33).

    For features of one family and targets of another this is cross-redundancy. Targets are numbered from 0; r2 is NULL where
    fewer than ``least`` rows have the target, or where it is constant.
    """
    sizes = df.select(F.max(F.size("features")).alias("f"), F.max(F.size("targets")).alias("t"), F.count_distinct("fold").alias("k")).first()
    features, out = sizes.f or 0, None
    for s, e in target_groups(features, sizes.t or 0, sizes.k):
        part = df.select(F.col("fold").cast("long").alias("fold"), F.col("features").cast("array<double>").alias("features"), F.slice(F.col("targets").cast("array<double>"), s + 1, e - s).alias("targets"))
        shared = df.sparkSession.sparkContext.broadcast(_by_fold(ridge_coefficients(part, features, e - s, penalty, width), e - s))

        def run(batches: Iterator[pa.RecordBatch], first: int = s, count: int = e - s, shared=shared) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((4, count))
            for batch in batches:
                x, folds = np.hstack([matrix(batch.column("features"), features), np.ones((batch.num_rows, 1))]), batch.column("fold").to_numpy()
                y = matrix(batch.column("targets"), count)
                for f in np.unique(folds).tolist():
                    t = y[folds == f]
                    known = np.isfinite(t)
                    error, t = np.where(known, t - x[folds == f] @ shared.value[f], 0.0), np.where(known, t, 0.0)
                    sums += np.stack([known.sum(axis=0), t.sum(axis=0), (t * t).sum(axis=0), (error * error).sum(axis=0)])
            yield pa.RecordBatch.from_pydict({"target": pa.array(np.arange(first, first + count), pa.int64()), "n": sums[0], "s": sums[1], "q": sums[2], "e": sums[3]})

        found = part.mapInArrow(run, "target long, n double, s double, q double, e double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], "target long, n long, r2 double")
    sums = out.groupBy("target").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "e")])
    spread = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    r2 = F.when((F.col("n") >= least) & (spread > 1e-12 * F.col("q")), 1 - F.col("e") / spread)
    return sums.select("target", F.col("n").cast("long").alias("n"), r2.alias("r2"))
