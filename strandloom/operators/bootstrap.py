"""Bootstrap by drawing n of n rows, and p-values of t-tests as column expressions (AG-18, AG-25, AG-32, ML-37).

A replicate's n draws are split down a tree of shards: at each node the draws of its left half are a binomial number whose
seed is the node, so a shard's numbers come out the same in whichever task asks, weights sum to n exactly in every replicate,
and no task holds more than a shard. Inside a shard each draw picks a row. The shards' sizes, SHARDS numbers at most, are all
that is sent about.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Shards at most, and rows that a shard has at least where there are enough.
SHARDS, SHARD_ROWS = 1 << 14, 20_000


def shard_draws(sizes: np.ndarray, shard: int, replicates: int, seed: int) -> np.ndarray:
    """Draws of one shard in every replicate; over all shards they sum to the rows' number."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, len(sizes)
    draws = np.full(replicates, bounds[-1], dtype=np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        total = bounds[high] - bounds[low]
        share = (bounds[middle] - bounds[low]) / total if total else 0.0
        left = np.random.default_rng([seed, low, high]).binomial(draws, share)
        if shard < middle:
            draws, high = left, middle
        else:
            draws, low = draws - left, middle
    return draws


def with_draws(df: DataFrame, key: str, replicates: int, seed: int = 0, name: str = "draws") -> DataFrame:
    """Append how often each row is drawn in each replicate, an array of ``replicates`` numbers; rows come back in any order.

    Which shard a row is in and its place there follow from its key; keys should differ, NULL is a key like others.
    """
    n = df.count()
    shards = max(1, min(SHARDS, n // SHARD_ROWS))
    placed = df.withColumn("__s", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(shards)).cast("int"))
    sizes = np.zeros(shards, dtype=np.int64)
    for r in placed.groupBy("__s").count().collect():  # one row a shard
        sizes[r["__s"]] = r["count"]
    columns = df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key) if table.num_rows > 1 else table
        shard, m = table.column("__s")[0].as_py(), table.num_rows
        weights = np.zeros((m, replicates), dtype=np.int32)
        for r, d in enumerate(shard_draws(sizes, shard, replicates, seed)):
            rng = np.random.default_rng([seed, shard, r, 1])
            weights[:, r] = np.bincount(rng.integers(0, m, int(d)), minlength=m)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * replicates, pa.int32()), pa.array(weights.ravel()))
        return table.select(columns).append_column(name, lists)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return placed.groupBy("__s").applyInArrow(run, f"{schema}, `{name}` array<int>")


def bootstrap_replicates(df: DataFrame, key: str, metrics: Mapping[str, Column], replicates: int, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, replicate, n, metrics) with the point, whose weights are 1, as replicate -1.

    ``metrics`` are aggregate columns in which ``F.col('w')`` is a row's weight. Replicates are summed where the rows are.
    """
    drawn = with_draws(df, key, replicates, seed, "__draws")
    every = F.concat(F.array(F.lit(1)), F.col("__draws"))
    rows = drawn.select(*df.columns, F.posexplode(every).alias("__r", "w")).where("w > 0").withColumn("replicate", F.col("__r") - 1)
    return rows.groupBy(*groups, "replicate").agg(F.sum("w").alias("n"), *[m.cast("double").alias(name) for name, m in metrics.items()])


def bootstrap_interval(df: DataFrame, key: str, metrics: Mapping[str, Column], replicates: int, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(metric, point, lo, hi, se): percentile interval over replicates of n of n rows (AG-25, UD-03).

    Fewer than three rows have their point for both ends and no spread.
    """
    values = bootstrap_replicates(df, key, metrics, replicates, seed)
    tidy = values.select("replicate", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x")).select("replicate", "n", "x.*")
    sample = F.when(F.col("replicate") >= 0, F.col("value"))
    # One row a replicate and metric from here on.
    found = tidy.groupBy("metric").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("value"))).alias("point"), F.percentile(sample, alpha / 2).alias("lo"), F.percentile(sample, 1 - alpha / 2).alias("hi"),
        F.stddev_samp(sample).alias("se"), F.max("n").alias("rows"),
    )
    few = F.col("rows") < 3
    return found.select("metric", "point", *[F.when(few, F.col("point")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")], F.when(~few, F.col("se")).alias("se"))


def turning_point(x: str, y: str, w: str = "w") -> Column:
    """Turning point of the weighted least-squares parabola of y on x, as an aggregate (AG-32); NULL for fewer than three values of x."""
    X, Y, W = F.col(x), F.col(y), F.col(w)
    n = F.sum(W)
    power = lambda k, more=F.lit(1.0): F.sum(W * F.pow(X, F.lit(k)) * more) / n
    mx = power(1)
    raw = [F.lit(1.0), mx, power(2), power(3), power(4)]
    central = lambda k: sum((F.lit(float(math.comb(k, i) * (-1) ** (k - i))) * raw[i] * F.pow(mx, F.lit(k - i)) for i in range(k + 1)), F.lit(0.0))
    s2, s3, s4 = central(2), central(3), central(4)
    my, xy, xxy = power(0, Y), power(1, Y), power(2, Y)
    t1 = xy - mx * my
    t2 = xxy - 2 * mx * xy + mx * mx * my - s2 * my
    # With u = x - mean: y ~ a + b u + c u^2; the turning point is mean - b / 2c.
    det = s2 * (s4 - s2 * s2) - s3 * s3
    b = F.try_divide(t1 * (s4 - s2 * s2) - s3 * t2, det)
    c = F.try_divide(s2 * t2 - s3 * t1, det)
    return mx - F.try_divide(b, 2 * c)


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight further up, for x of a half and more."""
    up = x + 8
    inverse = F.lit(1.0) / up
    square = inverse * inverse
    series = inverse / 12 * (1 - square * (F.lit(1 / 30) - square * (F.lit(1 / 105) - square * (F.lit(1 / 140) - square / 99))))
    steps = F.log(x)
    for i in range(1, 8):
        steps = steps + F.log(x + i)
    return (up - 0.5) * F.log(up) - up + F.lit(0.5 * math.log(2 * math.pi)) + series - steps


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """Continued fraction of the incomplete beta function by Lentz's method; converges for x below (a + 1) / (a + b + 2)."""
    tiny = F.lit(1e-300)
    guard = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    start = F.lit(1.0) / guard(1 - (a + b) * x / (a + 1))

    def step(held: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = F.lit(1.0) / guard(1 + even * held["d"])
        c = guard(1 + even / held["c"])
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d2 = F.lit(1.0) / guard(1 + odd * d)
        c2 = guard(1 + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (held["h"] * d * c * d2 * c2).alias("h"))

    first = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)["h"]


def t_test_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic, by the regularised incomplete beta function; NULL where there is no degree of freedom."""
    v, square = df.cast("double"), t * t
    a, b = v / 2, F.lit(0.5)
    x, rest = v / (v + square), square / (v + square)
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - F.lit(0.5 * math.log(math.pi)) + a * F.log(x) + b * F.log(rest))
    direct = front * _beta_fraction(a, b, x) / a
    turned = 1 - front * _beta_fraction(b, a, rest) / b
    p = F.when(square == 0, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), direct).otherwise(turned)
    return F.when((v > 0) & t.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def transfer_interval(predictions: DataFrame, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """(metric, point, lo, hi, se) of R2 and correlation of rows (key, label, prediction) on another screen (ML-37)."""
    y, p, w = F.col("label"), F.col("prediction"), F.col("w")
    mean = lambda c: F.sum(w * c) / F.sum(w)
    vy, vp = mean(y * y) - mean(y) * mean(y), mean(p * p) - mean(p) * mean(p)
    metrics = {"r2": 1 - F.try_divide(mean((y - p) * (y - p)), vy), "pearson": F.try_divide(mean(y * p) - mean(y) * mean(p), F.sqrt(vy * vp))}
    return bootstrap_interval(predictions.select(key, "label", "prediction"), key, metrics, replicates, seed=seed)


