"""Profile operators (PF-*, WN-07..10, WN-16): an ordered value per position of each row, in tidy form.

A profile is a DataFrame (id, pos, v); ``explode_profile`` makes one from an array column. Missing values are NULL.
Every operator is one aggregation by id, which combines before its shuffle, or one window by id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

Region = tuple[int, int]


def explode_profile(df: DataFrame, id_col: str, array_col: str, null_below: float | None = None) -> DataFrame:
    """Tidy (id, pos, v) with 1-based positions; NaN becomes NULL, and so do values under ``null_below`` in size."""
    v = F.col("v").cast("double")
    v = F.when(~F.isnan(v), v)
    if null_below is not None:
        v = F.when(F.abs(v) >= null_below, v)
    return df.select(F.col(id_col).alias("id"), F.posexplode(array_col).alias("p", "v")).select("id", (F.col("p") + 1).alias("pos"), v.alias("v"))


def in_region(region: Region) -> Column:
    return F.col("pos").between(*region)


def region_table(profile: DataFrame, regions: Mapping[str, Region]) -> DataFrame:
    """Rows of the profile with the regions that hold them."""
    found = F.array(*[F.when(in_region(r), F.lit(name)) for name, r in regions.items()])
    return profile.withColumn("region", F.explode(F.filter(found, lambda x: x.isNotNull())))


def regional_summary(profile: DataFrame, regions: Mapping[str, Region], dialect: str = "b") -> DataFrame:
    """Mean, spread, extremes, range and slope of each region.

    Dialect "a": sample spread, NULL spread as 0, slope after missing values are set to the region's mean.
    Dialect "b": population spread, slope over the values present, 0 where fewer than two.
    """
    rows = region_table(profile, regions)
    if dialect == "a":
        mean = F.avg("v").over(Window.partitionBy("id", "region"))
        rows = rows.withColumn("filled", F.coalesce("v", mean))
        spread = F.coalesce(F.stddev_samp("v"), F.lit(0.0))
    else:
        rows = rows.withColumn("filled", F.col("v"))
        spread = F.coalesce(F.stddev_pop("v"), F.lit(0.0))
    return rows.groupBy("id", "region").agg(
        F.avg("v").alias("mean"), spread.alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        (F.max("v") - F.min("v")).alias("width"), F.coalesce(F.regr_slope("filled", F.col("pos").cast("double")), F.lit(0.0)).alias("slope"),
    )


def region_means(profile: DataFrame, regions: Mapping[str, Region]) -> DataFrame:
    """One column of means a region."""
    return profile.groupBy("id").agg(*[F.avg(F.when(in_region(r), F.col("v"))).alias(name) for name, r in regions.items()])


def contrasts(means: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Differences of regional means."""
    return means.select("id", *[(F.col(a) - F.col(b)).alias(f"{a}_minus_{b}") for a, b in pairs])


def position_weights(n: int) -> dict[str, list[float]]:
    """Weights per position, each scheme summing to one."""
    raw = {
        "linear": [float(p) for p in range(1, n + 1)],
        "quadratic": [float(p * p) for p in range(1, n + 1)],
        "exponential": [2.0 ** (p / 8.0) for p in range(1, n + 1)],
        "seed_only": [1.0 if p > n - n // 4 else 0.0 for p in range(1, n + 1)],
        "middle_proximal": [0.0 if p <= n // 4 else 1.0 for p in range(1, n + 1)],
    }
    return {k: [w / sum(ws) for w in ws] for k, ws in raw.items()}


def weighted_statistics(profile: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean and spread, renormalised over the values present, extremes where the weight is positive, and
    the mean's difference and guarded ratio to the plain mean; ``weights`` is (scheme, pos, w)."""
    rows = profile.join(F.broadcast(weights), "pos")  # schemes times positions
    w = F.when(F.col("v").isNotNull(), F.col("w"))
    sums = rows.groupBy("id", "scheme").agg(
        F.sum(w).alias("sw"), F.sum(w * F.col("v")).alias("swv"), F.sum(w * F.col("v") * F.col("v")).alias("swvv"), F.avg("v").alias("plain"),
        F.min(F.when(F.col("w") > 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("w") > 0, F.col("v"))).alias("hi"),
    )
    mean = F.try_divide("swv", "sw")
    spread = F.sqrt(F.greatest(F.try_divide("swvv", "sw") - mean * mean, F.lit(0.0)))
    return sums.select("id", "scheme", mean.alias("mean"), spread.alias("sd"), "lo", "hi", (mean - F.col("plain")).alias("excess"), (mean / (F.abs("plain") + 1e-6)).alias("ratio"))


def _neighbours(profile: DataFrame) -> DataFrame:
    by = Window.partitionBy("id").orderBy("pos")
    return profile.withColumn("before", F.lag("v").over(by)).withColumn("after", F.lead("v").over(by))


def jumps(profile: DataFrame) -> DataFrame:
    """Adjacent differences: mean and largest size, spread, total variation, mean sign kept."""
    d = F.col("v") - F.col("before")
    return _neighbours(profile).withColumn("d", d).groupBy("id").agg(
        F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("max_abs"), F.stddev_pop("d").alias("sd"), F.sum(F.abs("d")).alias("total"), F.avg("d").alias("mean")
    )


def curvature(profile: DataFrame) -> DataFrame:
    """Second differences: mean and largest size, spread."""
    d = F.col("after") - 2 * F.col("v") + F.col("before")
    return _neighbours(profile).withColumn("d", d).groupBy("id").agg(F.avg(F.abs("d")).alias("mean_abs"), F.max(F.abs("d")).alias("max_abs"), F.stddev_pop("d").alias("sd"))


def extrema(profile: DataFrame) -> DataFrame:
    """Strict local peaks and troughs."""
    v, b, a = F.col("v"), F.col("before"), F.col("after")
    return _neighbours(profile).groupBy("id").agg(F.count_if((v > b) & (v > a)).alias("peaks"), F.count_if((v < b) & (v < a)).alias("troughs"))


def hotspot(profile: DataFrame, length: int) -> DataFrame:
    """First position of the largest value, its distance to the end, the value, and the first of the smallest."""
    top = F.max_by("pos", F.struct(F.col("v"), (-F.col("pos")).alias("p")))
    low = F.min_by("pos", F.struct(F.col("v"), F.col("pos")))
    return profile.where("v IS NOT NULL").groupBy("id").agg(
        top.alias("peak_pos"), (F.lit(length) - top).alias("to_end"), F.max("v").alias("peak"), low.alias("trough_pos")
    )


def safe_ratio(a: Column, b: Column) -> Column:
    """a / (|b| + 1e-6)."""
    return a / (F.abs(b) + 1e-6)


def coupling(means: DataFrame, a: str, b: str) -> DataFrame:
    """Product, guarded ratio and difference of two regional means."""
    x, y = F.col(a), F.col(b)
    return means.select("id", (x * y).alias("product"), safe_ratio(x, y).alias("ratio"), (x - y).alias("difference"))


def pair_means(profile: DataFrame) -> DataFrame:
    """Profile of adjacent pairs' means, at the first position: a higher-order unit built from the simpler one."""
    return _neighbours(profile).where("after IS NOT NULL").select("id", "pos", ((F.col("v") + F.col("after")) / 2).alias("v"))


def residual_between(upper: DataFrame, lower: DataFrame, regions: Mapping[str, Region]) -> DataFrame:
    """Higher-order regional mean minus the simpler unit's, and its size."""
    u, low = regional_summary(upper, regions).select("id", "region", F.col("mean").alias("u")), regional_summary(lower, regions).select("id", "region", F.col("mean").alias("l"))
    return u.join(low, ["id", "region"]).select("id", "region", (F.col("u") - F.col("l")).alias("residual"), F.abs(F.col("u") - F.col("l")).alias("size"))


def phased_sum(profile: DataFrame, period: float = 10.5) -> DataFrame:
    """Length of the vector sum of values turned by the helical phase, over the number of values."""
    angle = F.lit(2 * 3.141592653589793) * F.col("pos") / F.lit(period)
    return profile.groupBy("id").agg((F.hypot(F.sum(F.col("v") * F.cos(angle)), F.sum(F.col("v") * F.sin(angle))) / F.count("v")).alias("bend"))


def fill_with_column_median(profile: DataFrame) -> DataFrame:
    """Missing values set to their position's exact median over all rows, 0 where that is missing too."""
    medians = profile.groupBy("pos").agg(F.median("v").alias("m"))
    return profile.join(F.broadcast(medians), "pos").select("id", "pos", F.coalesce("v", "m", F.lit(0.0)).alias("v"))  # one row a position
