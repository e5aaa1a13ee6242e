"""Folds, train-fitted preprocessing and controls (ML-01..07, 14, 15, 21, 44). All draws are md5 arithmetic of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.ordering import exact_quantiles


def draw(seed: int, key: Column, bits: int = 32) -> Column:
    """Uniform whole number of a seed and a key, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, bits // 4), 16, 10).cast("long")


def random_folds(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Fold by the key's draw (ML-01): no shuffle, folds of equal size up to chance."""
    return df.withColumn(name, F.pmod(draw(seed, F.col(key)), F.lit(k)))


def exact_folds(df: DataFrame, key: str, k: int, seed: int, name: str = "fold", digits: int = 3) -> DataFrame:
    """Folds of equal size up to one (ML-01): ranks of the shuffled keys, dealt in turn.

    The order is (shard, digest), a shard being the digest's first ``digits`` hexadecimal digits; ranks are numbered inside shards and
    offset by the shards' prefix sums, so no window holds the table.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = df.withColumn("__d", digest).withColumn("__s", F.substring("__d", 1, digits))
    base = marked.groupBy("__s").count().select("__s", F.coalesce(F.sum("count").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # 16 ** digits rows
    inside = F.row_number().over(Window.partitionBy("__s").orderBy("__d", key))
    return marked.withColumn("__i", inside).join(F.broadcast(base), "__s").withColumn(name, F.pmod(F.col("__b") + F.col("__i") - 1, F.lit(k)).cast("long")).drop("__d", "__s", "__i", "__b")


def grouped_folds(df: DataFrame, group: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """All rows of a group in one fold; shuffled groups cut into k chunks, the first ones longer by one (ML-02)."""
    groups = df.select(group).distinct()
    ranked = exact_folds(groups, group, 1 << 62, seed, "__rank")
    n = groups.count()
    long, size = n % k, n // k
    edge = long * (size + 1)
    fold = F.when(F.col("__rank") < edge, F.floor(F.col("__rank") / (size + 1))).otherwise(F.lit(long) + F.floor((F.col("__rank") - edge) / max(size, 1)))
    return df.join(ranked.select(group, fold.cast("long").alias(name)), group)


def balanced_group_folds(df: DataFrame, group: str, k: int, name: str = "fold", digits: int = 3) -> DataFrame:
    """Whole groups dealt into folds of nearly equal size (ML-03): ranked from the largest down, there and back over the folds.

    The loads of two folds differ by no more than the largest group. Groups of one size are ranked by a digest, in shards
    whose prefix sums are added, so neither groups nor rows meet in one task, and none come to the driver. NULL is a group.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("__n")).withColumn("__d", F.md5(F.coalesce(F.col(group).cast("string"), F.lit("")))).withColumn("__s", F.substring("__d", 1, digits))
    # One row a size and shard.
    before = Window.orderBy(F.desc("__n"), "__s").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("__n", "__s").agg(F.count("*").alias("__c")).select("__n", "__s", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("__n", "__s").orderBy("__d", group)) - 1
    rank = F.col("__b") + F.col("__i")
    place = F.pmod(rank, F.lit(k))
    fold = F.when(F.pmod(F.floor(rank / k), F.lit(2)) == 0, place).otherwise(k - 1 - place)
    folds = sizes.withColumn("__i", inside).join(base, ["__n", "__s"]).select(F.col(group).alias("__g"), fold.cast("long").alias(name))
    return df.join(folds, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def spatial_groups(df: DataFrame, position: str, size: int, n: int, arcs: int = 5) -> DataFrame:
    """Bin and arc of a 1-based position (ML-04)."""
    return df.withColumn("bin", F.floor((F.col(position) - 1) / size)).withColumn("arc", F.least(F.floor((F.col(position) - 1) / (n / arcs)), F.lit(arcs - 1)))


def tidy(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, name, value) rows of columns."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(*keys, "x.*")


def train_statistics(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """(held, name, median, q1, q3, mean, sd) over the rows outside each held-out fold; NULL and NaN values do not count.

    Values are counted by fold and name once; the counts, not the rows, are copied to the folds that learn from them, and
    means and deviations are the total's sums less the fold's, about the name's mean over all rows.
    """
    held = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("held")
    counts = rows.where(F.col("value").isNotNull()).groupBy(F.col(fold).alias("own"), "name", "value").agg(F.count("*").alias("times"))
    spread = counts.select("*", held).where(F.col("held") != F.col("own"))
    q = exact_quantiles(spread, "value", [0.25, 0.5, 0.75], ["held", "name"], F.col("times"))
    n, v = F.col("times"), F.col("value") - F.col("centre")
    centres = counts.groupBy("name").agg((F.sum(F.col("value") * n) / F.sum(n)).alias("centre"))
    # One row a fold and column from here on.
    sums = counts.join(F.broadcast(centres), "name").groupBy("own", "name", "centre").agg(F.sum(n).alias("n"), F.sum(n * v).alias("s"), F.sum(n * v * v).alias("q"))
    rest = sums.select("*", held).where(F.col("held") != F.col("own")).groupBy("held", "name", "centre").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    moments = rest.select("held", "name", (F.col("centre") + mean).alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("sd"))
    every = rows.select("name").distinct().select("name", held)
    return every.join(moments, ["held", "name"], "left").join(q, ["held", "name"], "left").select(
        "held", "name", F.coalesce(F.col("quantiles")[1], F.lit(0.0)).alias("median"), F.col("quantiles")[0].alias("q1"), F.col("quantiles")[2].alias("q3"), "mean", "sd"
    )


def apply_train_statistics(rows: DataFrame, stats: DataFrame, fold: str) -> DataFrame:
    """Held-out rows imputed, winsorised and standardised by statistics that never saw them (ML-05, ML-06, ML-07)."""
    held = rows.join(F.broadcast(stats.withColumnRenamed("held", fold)), [fold, "name"])  # folds times columns
    filled = F.coalesce("value", "median")
    reach = F.when(F.col("q3") > F.col("q1"), 3 * (F.col("q3") - F.col("q1"))).otherwise(F.lit(3.0))
    clipped = F.greatest(F.least(filled, F.col("q3") + reach), F.col("q1") - reach)
    return held.withColumn("filled", filled).withColumn("clipped", clipped).withColumn("scaled", (F.col("filled") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0)))


def permuted(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    """The columns of another row, all of one row together (ML-14): rank by key joined to rank by draw."""
    by_key = _ranked(df.select(key), key, None).withColumnRenamed("__n", "__r")
    by_draw = _ranked(df.select(key, *columns), key, seed).withColumnRenamed("__n", "__r").drop(key)
    return by_key.join(by_draw, "__r").drop("__r")


def permuted_each(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    """Every column shuffled on its own (ML-15)."""
    out = df.select(key)
    for i, c in enumerate(columns):
        out = out.join(permuted(df, key, [c], seed + i), key)
    return out


def _ranked(df: DataFrame, key: str, seed: int | None) -> DataFrame:
    """Dense ranks from 0 in the order of a digest of the key, by shards."""
    return exact_folds(df, key, 1 << 62, -1 if seed is None else seed, "__n")


def noise(df: DataFrame, key: str, names: Sequence[str], seed: int) -> DataFrame:
    """Standard normal control columns by Box-Muller of two draws (ML-15)."""
    u = lambda s: (draw(s, F.col(key)) + 1) / F.lit(2.0**32 + 1)
    return df.select(key, *[(F.sqrt(-2 * F.log(u(seed + 2 * i))) * F.cos(F.lit(6.283185307179586) * u(seed + 2 * i + 1))).alias(c) for i, c in enumerate(names)])


def prefix_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Rows whose draw is in the first share: a prefix of one shuffled order, so samples nest (ML-21, ML-44)."""
    return df.where(draw(seed, F.col(key)) < int(share * (1 << 32)))


def cover_report(df: DataFrame, key: str, fold: str, folds: int) -> DataFrame:
    """(rows, keys, outside): folds cover every row once where rows = keys and outside = 0 (SO-06)."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(~F.col(fold).between(0, folds - 1) | F.col(fold).isNull()).alias("outside"))
