"""Ranks, running sums and moving means that need a global order, without a window over the whole table.

Equal values are counted first. A group of up to LARGE distinct values is one window over their counts. Larger groups are cut
into ranges by approximate quantiles of the distinct values, which are an aggregation of the plan itself, so nothing runs while
a plan is built; sums are taken inside each range, and the prefix sums of the ranges, of which there are few, are added.
Rows equal in the first order column share a range, so ties stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges at least; otherwise as many as there are shuffle partitions. Distinct values up to which a group is one window.
RANGES, LARGE = 64, 1 << 18


def _ranged(counts: DataFrame, column: str, groups: Sequence[str], name: str) -> DataFrame:
    """Append the 0-based range of each row of distinct values (groups, column) inside its group; NULL goes to the first.

    Cuts are searched in two steps of about the root of their number, each a sum of comparisons. They are one row a group, and
    a group has more than LARGE rows where there are groups, so they are broadcast: no group's rows meet in one task.
    """
    ranges = max(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = math.isqrt(ranges) + 1
    probe = F.col(column).cast("double")
    quantiles = F.percentile_approx(probe, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(2 * ranges))
    # The coarse cuts are picked here, once a group, and not again for every row.
    coarse = F.filter("__cuts", lambda c, i: i % step == step - 1)
    cuts = F.broadcast(counts.groupBy(*groups).agg(F.array_distinct(quantiles).alias("__cuts")).withColumn("__steps", coarse))
    marked = joined_or_null(counts, cuts, groups) if groups else counts.join(cuts, how="left")
    below = lambda part: F.size(F.filter(part, lambda c: c < F.col("__probe")))
    found = marked.withColumn("__probe", probe).withColumn("__coarse", below(F.col("__steps")))
    fine = F.slice("__cuts", F.greatest(F.col("__coarse"), F.lit(0)) * step + 1, F.lit(step))
    place = F.when(F.col("__cuts").isNull() | F.col("__probe").isNull(), F.lit(0)).otherwise(F.col("__coarse") * step + below(fine))
    return found.withColumn(name, place.cast("int")).drop("__cuts", "__steps", "__probe", "__coarse")


def placed_counts(df: DataFrame, column: str, groups: Sequence[str] = (), times: Column | None = None) -> DataFrame:
    """(groups, column, __c, __i, __n): copies of each distinct value that is not NULL, the group's rows up to and with it, and all.

    Groups of up to LARGE distinct values are one window each; larger ones are summed by ranges.
    """
    counted = F.count("*") if times is None else F.sum(times)
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(counted.alias("__c"))
    # One row a large group, so fewer rows by LARGE than there are distinct values. The rows' sum, which is no less, is asked for
    # too, so that all three readers of the counts ask for the same columns and share their shuffle.
    sizes = counts.groupBy(*groups).agg(F.count(column).alias("__d"), F.sum("__c").alias("__all"))
    large = F.broadcast(sizes.where((F.col("__d") > LARGE) & (F.col("__all") > LARGE)).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__d"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)], F.lit(True))
    by_group = Window.partitionBy(*groups)
    running = by_group.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    small = counts.join(large, same, "left_anti").withColumn("__i", F.sum("__c").over(running)).withColumn("__n", F.sum("__c").over(by_group))
    ranged = _ranged(counts.join(large, same, "left_semi"), column, groups, "__r")
    inside = Window.partitionBy(*groups, "__r").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    before = by_group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    # One row a group and range.
    base = ranged.groupBy(*groups, "__r").agg(F.sum("__c").alias("__s")).withColumn("__b", F.coalesce(F.sum("__s").over(before), F.lit(0))).withColumn("__n", F.sum("__s").over(by_group)).drop("__s")
    summed = joined_or_null(ranged.withColumn("__i", F.sum("__c").over(inside)), base, [*groups, "__r"])
    return small.unionByName(summed.withColumn("__i", F.col("__i") + F.col("__b")).drop("__r", "__b"))


def with_running_sum(df: DataFrame, order: str, value: Column, name: str, ties: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Append the inclusive running sum of ``value`` in the order of ``order``, then of ``ties``.

    Rows equal in ``order`` are one range of their own if there are many: their order among themselves is that of ``ties``.
    """
    sign = -1 if descending else 1
    counts = df.groupBy(order).agg(F.count("*").alias("__c"))
    ranged = _ranged(counts, order, [], "__r").select(order, "__r")
    marked = joined_or_null(df.withColumn("__v", value), ranged, [order]).withColumn("__r", F.col("__r") * sign)
    keys = [F.desc(order) if descending else F.asc(order), *ties]
    inside = Window.partitionBy("__r").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # One row a range.
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy("__r").agg(F.sum("__v").alias("__s")).select("__r", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    return marked.withColumn("__i", F.sum("__v").over(inside)).join(F.broadcast(base), "__r").withColumn(name, F.col("__b") + F.col("__i")).drop("__v", "__r", "__i", "__b")


def average_rank(df: DataFrame, column: str, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """Append the average rank of a numeric column inside ``groups``, or over the table (WN-01); divide by n for percentages.

    NULL has no rank and counts for none. Equal values are counted first; the counts are summed inside ranges of the
    values and over each group's ranges, so neither ties nor a large group meet in one task.
    """
    placed = placed_counts(df, column, groups)
    ranks = placed.withColumn(name, F.col("__i") - (F.col("__c") - 1) / F.lit(2.0)).select(*groups, column, name)
    return joined_or_null(df, ranks, [*groups, column])


def joined_or_null(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    other = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)])
    return left.join(other, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def clipped_mean(df: DataFrame, position: str, value: str, before: int, after: int, name: str, block: int = 4096) -> DataFrame:
    """Append the mean over positions from ``before`` below to ``after`` above, shortened at the ends (WN-05).

    Integer positions are cut into blocks; a row near a block's edge is also sent to the block that needs it.
    """
    return _blocked_mean(df, position, value, before, after, name, block)


def circular_mean(df: DataFrame, position: str, value: str, before: int, after: int, n: int, name: str, block: int = 4096) -> DataFrame:
    """As ``clipped_mean`` for 1-based positions on a circle of ``n``: the ends continue each other (WN-04)."""
    shift = F.explode(F.array(F.lit(-n), F.lit(0), F.lit(n)))
    turned = df.withColumn("__k", shift).withColumn("__p", F.col(position) + F.col("__k")).where(F.col("__p").between(1 - before, n + after))
    out = _blocked_mean(turned.drop(position).withColumnRenamed("__p", position), position, value, before, after, name, block)
    return out.where("__k = 0").drop("__k")


def _blocked_mean(df: DataFrame, position: str, value: str, before: int, after: int, name: str, block: int) -> DataFrame:
    block = max(block, before + after)
    p = F.col(position).cast("long")
    home = F.floor(p / block)
    sent = df.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((p - after) / block), home, F.floor((p + before) / block)))))
    frame = Window.partitionBy("__b").orderBy(p).rangeBetween(-before, after)
    return sent.withColumn(name, F.avg(value).over(frame)).where(F.col("__b") == home).drop("__b")


def running_extremes(df: DataFrame, position: str, step: str) -> DataFrame:
    """Positions of the least and the greatest running sum of ``step``, first of ties (WN-06)."""
    summed = with_running_sum(df, position, F.col(step), "cum")
    return summed.agg(F.min_by(position, F.struct("cum", position)).alias("argmin"), F.min_by(position, F.struct((-F.col("cum")).alias("c"), position)).alias("argmax"))


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], groups: Sequence[str] = (), times: Column | None = None) -> DataFrame:
    """(groups, quantiles): exact linear quantiles of the values that are not NULL, without a group in one task.

    Equal values are counted first and the counts summed in ranges; the order statistics that the quantiles lie between
    are then two values each.
    """
    placed = placed_counts(df, column, groups, times)
    last = F.col("__i")  # rank of the value's last copy, from 1
    first = last - F.col("__c") + 1
    value, out = F.col(column).cast("double"), []
    for i, q in enumerate(shares):
        at = (F.col("__n") - 1) * F.lit(float(q)) + 1
        low = F.max(F.when((first <= F.floor(at)) & (F.floor(at) <= last), value))
        high = F.max(F.when((first <= F.ceil(at)) & (F.ceil(at) <= last), value))
        out += [low.alias(f"__l{i}"), high.alias(f"__h{i}")]
    found = placed.groupBy(*groups).agg(F.max("__n").alias("__n"), *out)
    part = [(F.col("__n") - 1) * F.lit(float(q)) - F.floor((F.col("__n") - 1) * F.lit(float(q))) for q in shares]
    return found.select(*groups, F.array(*[F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * p for i, p in enumerate(part)]).alias("quantiles"))


def quantile_cuts(df: DataFrame, column: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, cut): the greatest value of each of ``bins`` equal shares of the values but the last; equal values are not cut apart."""
    placed = placed_counts(df, column, groups)
    share = F.floor((F.col("__i") - 1) * bins / F.col("__n"))
    cuts = placed.groupBy(*groups, share.alias("__share")).agg(F.max(column).alias("cut"))
    top = placed.groupBy(*groups).agg(F.max(column).alias("__top"))
    return joined_or_null(cuts, top, list(groups)).where(F.col("cut") < F.col("__top")).select(*groups, "cut")


def quantile_bands(df: DataFrame, column: str, bands: int, name: str) -> DataFrame:
    """Append the band between exact linear quantiles: half-open, the last one closed (WN-15)."""
    cuts = exact_quantiles(df, column, [i / bands for i in range(1, bands)]).withColumnRenamed("quantiles", "__cuts")
    return df.join(F.broadcast(cuts), how="left").withColumn(name, F.size(F.filter("__cuts", lambda c: c <= F.col(column)))).drop("__cuts")  # one row


def running_best(df: DataFrame, run: str, trial: str, score: str) -> DataFrame:
    """Best score so far and trials since it last rose, per run (WN-12)."""
    by = Window.partitionBy(run).orderBy(trial)
    best = df.withColumn("best", F.max(score).over(by)).withColumn("__last", F.lag("best").over(by))
    rose = best.withColumn("__at", F.when(F.col("__last").isNull() | (F.col("best") > F.col("__last")), F.col(trial)))
    return rose.withColumn("since", F.col(trial) - F.last("__at", ignorenulls=True).over(by)).drop("__last", "__at")


def longest_run(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, longest, share): longest run of one character and its share of the length (WN-13)."""
    chars = df.select(key, F.length(text).alias("n"), F.posexplode(F.split(text, "")).alias("p", "c"))
    island = chars.withColumn("i", F.col("p") - F.row_number().over(Window.partitionBy(key, "c").orderBy("p")))
    return island.groupBy(key, "n", "c", "i").count().groupBy(key, "n").agg(F.max("count").alias("longest")).select(key, "longest", (F.col("longest") / F.col("n")).alias("share"))


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group (ST-01, ST-02)."""
    by = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def insulation(df: DataFrame, bin_col: str, value: str, n: int, reach: int) -> DataFrame:
    """(right - left) / (right + left) of the ``reach`` bins on either side on a circle of bins, 0 where empty (WN-17)."""
    spread = df.withColumn("__d", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).where("__d <> 0").select(F.pmod(F.col(bin_col) - F.col("__d"), F.lit(n)).alias(bin_col), "__d", value)
    sums = spread.groupBy(bin_col).agg(F.sum(F.when(F.col("__d") > 0, F.col(value))).alias("r"), F.sum(F.when(F.col("__d") < 0, F.col(value))).alias("l"))
    r, l = F.coalesce("r", F.lit(0.0)), F.coalesce("l", F.lit(0.0))  # noqa: E741
    return sums.select(bin_col, F.coalesce(F.try_divide(r - l, r + l), F.lit(0.0)).alias("insulation"))
