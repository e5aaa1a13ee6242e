"""Aggregations and statistics (AG-*). Correlations come from covariances, so constant columns give NULL or 0, not errors."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from strandloom.operators.bootstrap import t_test_p
from strandloom.operators.ordering import average_rank, exact_quantiles, joined_or_null, placed_counts, with_running_sum
from strandloom.sources.workspace import stored


def two_level_spread(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Per outer key mean and population spread of the inner means, then their mean and both spreads (AG-01, AG-02)."""
    folds = df.groupBy(outer, inner).agg(F.avg(value).alias("m"))
    seeds = folds.groupBy(outer).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    overall = seeds.agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"), F.stddev_samp("mean").alias("sd_sample"))
    return seeds.withColumn("sd_sample", F.lit(None).cast("double")).withColumn("level", F.col(outer).cast("string")).select("level", "mean", "sd", "sd_sample").unionByName(overall.select(F.lit("all").alias("level"), "mean", "sd", "sd_sample"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(column, count), NULL counted as a value (AG-03, AG-09)."""
    return df.groupBy(column).count()


def mean_of_duplicates(df: DataFrame, key: str, value: str, order: str, carried: Sequence[str]) -> DataFrame:
    """One row a key: mean of the value, the rest from the first row in order (AG-06)."""
    return df.groupBy(key).agg(F.avg(value).alias(value), *[F.min_by(c, order).alias(c) for c in carried], F.count("*").alias("n"))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key (AG-07)."""
    by = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def best_row(df: DataFrame, group: str, metric: str, tie: str, carried: Sequence[str]) -> DataFrame:
    """Row with the greatest metric, the smallest tie key of equals (AG-14)."""
    best = F.max_by(F.struct(metric, tie, *carried), F.struct(F.col(metric), (-F.col(tie)).alias("t")))
    return df.groupBy(group).agg(best.alias("b")).select(group, "b.*")


def pivot_gain(df: DataFrame, index: str, arm: str, arms: Sequence[str], value: str, baseline: str) -> DataFrame:
    """Mean of every arm side by side and its gain over the baseline (AG-12)."""
    wide = df.groupBy(index).pivot(arm, list(arms)).agg(F.avg(value))
    return wide.select(index, *[F.col(a) for a in arms], *[(F.col(a) - F.col(baseline)).alias(f"{a}_gain") for a in arms if a != baseline])


def pearson(x: str, y: str) -> Column:
    """Pearson correlation, 0 where either side is constant (AG-15)."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def spearman_by(df: DataFrame, groups: Sequence[str], x: str, y: str, least: int = 1) -> DataFrame:
    """Rank correlation per group of at least ``least`` complete rows, average ranks, 0 for constants (AG-15, AG-16, AG-23)."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).agg(F.count("*").alias("__m"))
    # Both sides' values are ranked in one pass.
    sides = full.select(*groups, "__m", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("__x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("__y").alias("v")))).alias("s")).select(*groups, "__m", F.col("s.side").alias("__side"), F.col("s.v").alias("__value"))
    placed = placed_counts(sides, "__value", [*groups, "__side"], F.col("__m"))
    # Twice the rank less twice the mean rank: whole numbers.
    rank = 2 * F.col("__i") - F.col("__c") - F.col("__n")
    of = lambda side, value, name: placed.where(F.col("__side") == side).select(*groups, F.col("__value").alias(value), rank.cast("double").alias(name))
    both = joined_or_null(joined_or_null(full, of(0, "__x", "__a"), [*groups, "__x"]), of(1, "__y", "__b"), [*groups, "__y"])
    a, b, m = F.col("__a"), F.col("__b"), F.col("__m")
    rho = F.coalesce(F.try_divide(F.sum(m * a * b), F.sqrt(F.sum(m * a * a)) * F.sqrt(F.sum(m * b * b))), F.lit(0.0))
    return both.groupBy(*groups).agg(F.sum(m).alias("n"), rho.alias("rho")).where(F.col("n") >= least)


def fit_quality(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """R2 = 1 - SSE/SST and mean squared error (AG-17); one pass, SST from the variance."""
    e = F.col(y) - F.col(p)
    return df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))


def paired_t(df: DataFrame, groups: Sequence[str], delta: str) -> DataFrame:
    """(groups, n, mean, t, p): t statistic of paired differences and its two-sided p-value, NULL where they are constant (AG-18)."""
    t = F.try_divide(F.avg(delta), F.stddev_samp(delta) / F.sqrt(F.count("*").cast("double")))
    found = df.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(delta).alias("mean"), t.alias("t"))
    return found.withColumn("p", t_test_p(F.col("t"), F.col("n") - 1))


def within_group_variance_share(df: DataFrame, group: str, value: str, least: int) -> DataFrame:
    """Share of the variance that is inside groups of at least ``least`` rows (AG-13)."""
    by = Window.partitionBy(group)
    held = df.withColumn("__m", F.avg(value).over(by)).withColumn("__n", F.count("*").over(by)).where(F.col("__n") >= least)
    return held.withColumn("__e", F.col(value) - F.col("__m")).agg(F.count("*").alias("n"), F.try_divide(F.var_samp("__e"), F.var_samp(value)).alias("share"))


def concentration(df: DataFrame, key: str, weight: str, shares: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Effective number, Gini coefficient and the least numbers that hold the shares (AG-19, WN-11)."""
    total = df.agg(F.sum(weight).alias("all"), F.count("*").alias("n"))
    up = with_running_sum(df.select(key, weight), weight, F.col(weight), "cum", ties=[key], descending=True)
    ranked = with_running_sum(up, weight, F.lit(1), "rank", ties=[key], descending=True).join(F.broadcast(total))  # one row
    share = F.col(weight) / F.col("all")
    reach = [F.min(F.when(F.col("cum") >= q * F.col("all"), F.col("rank"))).alias(f"n_{round(100 * q)}") for q in shares]
    ascending = F.col("n") - F.col("rank") + 1
    gini = F.sum((2 * ascending - F.col("n") - 1) * F.col(weight)) / (F.max("n") * F.sum(weight))
    return ranked.agg(F.try_divide(F.lit(1.0), F.sum(share * share)).alias("effective"), gini.alias("gini"), *reach)


def kuncheva(sets: DataFrame, fold: str, item: str, universe: int) -> DataFrame:
    """Chance-corrected overlap of every two folds' sets (AG-20)."""
    size = sets.groupBy(fold).agg(F.count("*").alias("k"))
    a = sets.join(size, fold)
    b = a.select(F.col(fold).alias("other"), item, F.col("k").alias("k2"))
    common = a.join(b, item).where(F.col(fold) < F.col("other")).groupBy(fold, "other").agg(F.count("*").alias("r"))
    pairs = size.select(fold, "k").join(size.select(F.col(fold).alias("other"), F.col("k").alias("k2")), F.col(fold) < F.col("other")).join(common, [fold, "other"], "left")  # folds are few
    r, k = F.coalesce("r", F.lit(0)), (F.col("k") + F.col("k2")) / 2.0
    return pairs.select(fold, "other", F.coalesce(F.try_divide(r - k * k / universe, k - k * k / universe), F.lit(0.0)).alias("index"))


def top_share_precision(df: DataFrame, y: str, p: str, key: str, q: float) -> DataFrame:
    """Share of the top q by truth that is in the top q by prediction (AG-21)."""
    n = df.count()
    k = max(1, int(n * q))
    by_y = with_running_sum(df.select(key, y, p), y, F.lit(1), "ry", ties=[key], descending=True)
    both = with_running_sum(by_y, p, F.lit(1), "rp", ties=[key], descending=True)
    return both.agg((F.count_if((F.col("ry") <= k) & (F.col("rp") <= k)) / F.lit(k)).alias("precision"))


def pick_percentile(df: DataFrame, groups: Sequence[str], y: str, p: str, key: str, k: int) -> DataFrame:
    """Expected percentile of the truth of the best-predicted of k draws with replacement, in closed form (AG-22)."""
    by = Window.partitionBy(*groups).orderBy(p, key)
    ranked = average_rank(df, y, "__ry", groups).withColumn("__j", F.row_number().over(by)).withColumn("__n", F.count("*").over(Window.partitionBy(*groups)))
    weight = F.pow(F.col("__j") / F.col("__n"), F.lit(k)) - F.pow((F.col("__j") - 1) / F.col("__n"), F.lit(k))
    return ranked.groupBy(*groups).agg(F.sum(weight * F.col("__ry") / F.col("__n")).alias("percentile"))


def calibration(df: DataFrame, groups: Sequence[str], y: str, p: str) -> DataFrame:
    """Slope and intercept of truth on prediction, NULL where the prediction is constant (AG-24)."""
    return df.groupBy(*groups).agg(F.regr_slope(y, p).alias("slope"), F.regr_intercept(y, p).alias("intercept"))


def dependency_conflicts(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Least value and number of distinct values per key; more than one is a conflict (AG-27)."""
    return df.groupBy(*key).agg(F.min(value).alias("value"), F.count_distinct(value).alias("values")).withColumn("conflict", F.col("values") > 1)


def coverage(df: DataFrame, unit: str, key: str, sizes: dict[str, int]) -> DataFrame:
    """Distinct keys over the size of the key space (AG-28)."""
    size = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(unit))
    return df.groupBy(unit).agg(F.count_distinct(key).alias("seen")).withColumn("share", F.col("seen") / size)


def noise_verdict(df: DataFrame, effect: str, floor: str) -> DataFrame:
    """Effect over noise floor and its band: under 1.5, under 5, above; no floor is above (AG-30)."""
    ratio = F.try_divide(F.abs(effect), F.col(floor))
    return df.withColumn("ratio", ratio).withColumn("verdict", F.when(F.col("ratio") < 1.5, "noise").when(F.col("ratio") < 5, "weak").otherwise("clear"))


def reliability(r: Column) -> Column:
    """Ceiling from an agreement: square root of the Spearman-Brown corrected value (AG-31)."""
    return F.sqrt(2 * r / (1 + r))


def quadratic_fit(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares y = a + b x + c x^2 from centred moments, R2 and turning point (AG-32).

    One pass for the means, one for the moments; NULL where x takes fewer than three values.
    """
    means = df.groupBy(*groups).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    c = df.join(means, list(groups)).withColumn("__u", F.col(x) - F.col("__mx")).withColumn("__v", F.col(y) - F.col("__my"))
    u, v = F.col("__u"), F.col("__v")
    m = c.groupBy(*groups, "__mx", "__my").agg(
        F.count("*").alias("n"), F.avg(u * u).alias("s2"), F.avg(u * u * u).alias("s3"), F.avg(u * u * u * u).alias("s4"), F.avg(u * v).alias("t1"), F.avg(u * u * v).alias("t2"), F.avg(v * v).alias("vv")
    )
    det = F.col("s2") * (F.col("s4") - F.col("s2") * F.col("s2")) - F.col("s3") * F.col("s3")
    slope = F.try_divide(F.col("t1") * (F.col("s4") - F.col("s2") * F.col("s2")) - F.col("s3") * F.col("t2"), det)
    bend = F.try_divide(F.col("s2") * F.col("t2") - F.col("s3") * F.col("t1"), det)
    fit = m.withColumn("__b", slope).withColumn("__c", bend)
    return fit.select(
        *groups, "n", F.col("__c").alias("c"), (F.col("__b") - 2 * F.col("__c") * F.col("__mx")).alias("b"),
        F.try_divide(F.col("__b") * F.col("t1") + F.col("__c") * F.col("t2"), F.col("vv")).alias("r2"),
        (F.col("__mx") - F.try_divide(F.col("__b"), 2 * F.col("__c"))).alias("turning_point"),
    )


def share_by_category(df: DataFrame, category: str, weight: str, labels: DataFrame) -> DataFrame:
    """Weight and share of every label, 0 where a label is missing (AG-35)."""
    sums = df.groupBy(category).agg(F.sum(weight).alias("w"))
    filled = labels.join(sums, category, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = filled.agg(F.sum("w").alias("all"))
    return filled.join(F.broadcast(total)).select(category, "w", F.coalesce(F.try_divide("w", "all"), F.lit(0.0)).alias("share"))  # one row


def describe(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Count, mean, spread, extremes and exact quartiles (AG-38)."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], groups)
    sums = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    # One row a group on either side.
    return sums.join(q, list(groups) or None, "left").select(
        *groups, "n", "mean", "sd", "lo", *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))], "hi"
    )


def _add_pairs(own: dict[tuple[int, int], np.ndarray], row: np.ndarray, at: np.ndarray, values: np.ndarray, columns: int, crossed: int | None) -> None:
    """Add the pairs of every row's entries to the sums of their blocks; the last of entries at one place counts."""
    order = np.lexsort((at, row))  # stable
    row, at, values = row[order], at[order], values[order]
    last = np.append((row[1:] != row[:-1]) | (at[1:] != at[:-1]), True)[: len(row)]
    row, at, values = row[last], at[last], values[last]
    first, apart = np.arange(len(row)), 0
    while len(first):
        second = first + apart
        first = first[(second < len(row)) & (row[np.minimum(second, len(row) - 1)] == row[first])]
        second = first + apart
        a, b = at[first] // columns, at[second] // columns
        for i, j in np.unique(np.stack([a, b]), axis=1).T.tolist():
            if crossed is not None and not i < crossed <= j:
                continue
            here = (a == i) & (b == j)
            x, y = values[first[here]], values[second[here]]
            place = (at[first[here]] % columns) * columns + at[second[here]] % columns
            held = own.setdefault((i, j), np.zeros((6, columns, columns))).reshape(6, -1)
            for total, v in zip(held, (1.0, x * y, x, y, x * x, y * y)):
                np.add.at(total, place, v)
        apart += 1


def pair_sums(df: DataFrame, group: str, key: str, pos: str, value: str, columns: int = 512, crossed: int | None = None) -> DataFrame:
    """(group, i, j, n, s, x, y, xx, yy) of every two columns i <= j of a tidy table, over the keys that have both.

    n counts them; s, x, y, xx and yy are the sums of the product, of either value and of either square. Rows are
    gathered as sparse lists; a task multiplies matrices of them, a block of ``columns`` by another at a time, or adds pair
    by pair where rows are short, and sends one row a pair of columns for all its rows. Positions are whole numbers, NULL values are left out. With ``crossed`` only
    pairs of a column in a block below that number and one in a block from it on are made.
    """
    names = [f.name for f in T.StructType.fromDDL("n double, s double, x double, y double, xx double, yy double").fields]
    held = df.where(F.col(value).isNotNull()).select(F.col(group).cast("long").alias("g"), F.col(key).alias("k"), F.col(pos).cast("int").alias("p"), F.col(value).cast("double").alias("v"))
    wide = held.groupBy("g", "k").agg(F.collect_list("p").alias("p"), F.collect_list("v").alias("v")).select("g", "p", "v")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for batch in batches:
            group_of = batch.column("g").to_numpy(zero_copy_only=False)
            sizes = batch.column("p").value_lengths().to_numpy()
            at, values = batch.column("p").flatten().to_numpy(), batch.column("v").flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            for g in np.unique(group_of).tolist():
                own = sums.setdefault(g, {})
                inside = np.flatnonzero(group_of[row] == g)
                lengths = sizes[group_of == g].astype(np.int64)
                if (lengths * (lengths + 1)).sum() <= 2 * columns * len(lengths):
                    _add_pairs(own, row[inside], at[inside], values[inside], columns, crossed)
                    continue
                _, r = np.unique(row[inside], return_inverse=True)
                blocks = {}
                for b in np.unique(at[inside] // columns).tolist():
                    here = at[inside] // columns == b
                    x, m = np.zeros((2, len(lengths), columns))
                    x[r[here], at[inside][here] % columns], m[r[here], at[inside][here] % columns] = values[inside][here], 1.0
                    blocks[b] = (x, m)
                for a, (x, m) in blocks.items():
                    for b, (y, o) in blocks.items():
                        if a <= b and (crossed is None or a < crossed <= b):
                            found = np.stack([m.T @ o, x.T @ y, x.T @ o, m.T @ y, (x * x).T @ o, m.T @ (y * y)])
                            own[a, b] = own[a, b] + found if (a, b) in own else found
        for g, own in sums.items():
            for (a, b), found in own.items():
                i, j = np.nonzero(found[0])
                upper = (a < b) | (i <= j)
                i, j = i[upper], j[upper]
                ids = {"g": np.full(len(i), g), "i": (i + a * columns).astype(np.int32), "j": (j + b * columns).astype(np.int32)}
                yield pa.RecordBatch.from_pydict(ids | {n: f[i, j] for n, f in zip(names, found)})

    parts = wide.mapInArrow(products, "g long, i int, j int, n double, s double, x double, y double, xx double, yy double")
    return parts.groupBy(F.col("g").alias(group), "i", "j").agg(*[F.sum(n).alias(n) for n in names])


def gram(df: DataFrame, group: str, key: str, pos: str, value: str) -> DataFrame:
    """(group, i, j, s): sums of products of a tidy table's columns, the normal equations of a regression (AG-33)."""
    return pair_sums(df, group, key, pos, value).select(group, "i", "j", "s")


def row_bootstrap(df: DataFrame, key: str, metrics: Mapping[str, Column], replicates: int, alpha: float = 0.05) -> DataFrame:
    """(metric, point, lo, hi, se) by a Poisson bootstrap of the rows (AG-25, UD-03).

    ``metrics`` are the callbacks: name -> aggregate column in which ``F.col('w')`` is a row's weight, for instance
    ``F.sum(F.col('w') * e) / F.sum('w')``. A row's weight in a replicate is a Poisson(1) number drawn by md5 of the
    replicate and its key, which is what drawing n of n rows with replacement tends to; the point has weights 1. The
    work is replicates times rows, summed where the rows are.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", "__rep", F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    steps = list(itertools.accumulate(math.exp(-1) / math.factorial(i) for i in range(12)))
    # The draw is a column of its own, so that its digest is made once a row and replicate and not once a step.
    weight = reduce(lambda acc, p: acc + (F.col("__u") >= p).cast("double"), steps, F.lit(0.0))
    drawn = df.withColumn("__rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1)))).withColumn("__u", draw).withColumn("w", F.when(F.col("__rep") < 0, F.lit(1.0)).otherwise(weight))
    values = drawn.groupBy("__rep").agg(*[m.cast("double").alias(f"m{i}") for i, m in enumerate(metrics.values())])
    tidy = values.select("__rep", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(metrics)])).alias("x")).select("__rep", "x.*")
    sample = F.when(F.col("__rep") >= 0, F.col("value"))
    # One row a replicate and metric from here on.
    return tidy.groupBy("metric").agg(
        F.max(F.when(F.col("__rep") < 0, F.col("value"))).alias("point"), F.percentile(sample, alpha / 2).alias("lo"),
        F.percentile(sample, 1 - alpha / 2).alias("hi"), F.stddev_samp(sample).alias("se"),
    )


def quality_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(rows, check...): how many rows meet each condition, NULL counted as not (AG-29)."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in checks.items()])


def direction_summary(df: DataFrame, name: str, value: str, contribution: str) -> DataFrame:
    """Per attribute mean and five quantiles of the contribution, and its correlation with the value (AG-39)."""
    q = exact_quantiles(df, contribution, [0.0, 0.25, 0.5, 0.75, 1.0], [name])
    sums = df.groupBy(name).agg(F.count(contribution).alias("n"), F.avg(contribution).alias("mean"), pearson(value, contribution).alias("direction"))
    # One row an attribute on either side.
    return sums.join(q, name).select(name, "n", "mean", *[F.col("quantiles")[i].alias(f"q{25 * i}") for i in range(5)], "direction")


def group_rank_summary(df: DataFrame, group: str, x: str, y: str, least: int) -> DataFrame:
    """(groups, mean, sd, median) of the rank correlations of groups with at least ``least`` rows (AG-23)."""
    rho = stored(spearman_by(df, [group], x, y, least), "rank-correlations")  # one row a group, read twice
    middle = exact_quantiles(rho, "rho", [0.5]).select(F.col("quantiles")[0].alias("median"))
    return rho.agg(F.count("*").alias("groups"), F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd")).join(middle, how="left")  # one row each


def group_bootstrap(df: DataFrame, groups: DataFrame, group: str, value: str, replicates: int, keep_multiplicity: bool) -> DataFrame:
    """(replicate, mean) over groups drawn with replacement by md5 (AG-25, AG-26).

    ``groups`` is (g, slot) with slots 0..n-1. A bag counts a group as often as it is drawn, a mask once.
    The group sums are joined, not the rows, so the work is replicates times groups.
    """
    n = groups.count()
    draws = groups.select("slot").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    seed = F.concat_ws(":", "replicate", "slot")
    draws = draws.select("replicate", F.pmod(F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long"), F.lit(n)).alias("slot"))
    if not keep_multiplicity:
        draws = draws.distinct()
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    held = draws.join(groups, "slot").join(sums, F.col("g") == F.col(group))
    return held.groupBy("replicate").agg((F.sum("s") / F.sum("c")).alias("mean"))


def interaction(df: DataFrame, a: str, b: str, name: str, centre: float | None = None) -> DataFrame:
    """Append the product of a centred column and another, centred at ``centre`` or at its own mean (SC-24)."""
    means = df.agg(F.avg(a).alias("__a"), (F.avg(b) if centre is None else F.lit(centre)).alias("__b"))
    joined = df.join(F.broadcast(means))  # one row
    return joined.withColumn(name, (F.col(a) - F.col("__a")) * (F.col(b) - F.col("__b"))).drop("__a", "__b")
