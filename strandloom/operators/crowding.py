"""Places in three dimensions and contact maps (FF-E, SRC-09): crowding by a grid join, contact sums, dependence on a mutant.

A grid's cells are as wide as the radius asked for, so a point's neighbours lie in its own cell and the 26 around it: an
equi-join on cells, with no pair of points further apart than two cells. The nearest k are found by shells: a point with k
others within the radius is done; the others go on with twice the radius. All points stay on the other side of the join.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandloom.sources.workspace import stored

#: Neighbours per point that the first shell aims at.
FIRST_SHELL = 8


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(i, x, y, z) of a whitespace table of coordinates, i being the line's number from 0 (SRC-09); other lines are errors.

    Lines are numbered inside the file's splits and moved by the splits' prefix sums.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("id")).where("size(c) >= 3")
    split, inside = F.shiftright("id", 33), Window.partitionBy("split").orderBy("id")
    marked = lines.withColumn("split", split).withColumn("n", F.row_number().over(inside) - 1)
    # One row a split.
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy("split").agg(F.count("*").alias("c")).select("split", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    return marked.join(F.broadcast(base), "split").select((F.col("base") + F.col("n")).alias("i"), *[F.col("c")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


def _near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(i, j, d) of different points of two tables (i, x, y, z) within the radius."""
    cell = lambda a: F.floor(F.col(a) / radius).cast("long")
    steps = [F.struct(*[F.lit(s).alias(a) for a, s in zip("uvw", step)]) for step in itertools.product((-1, 0, 1), repeat=3)]
    asked = left.withColumn("s", F.explode(F.array(*steps))).select("i", "x", "y", "z", *[(cell(a) + F.col(f"s.{c}")).alias(c) for a, c in zip("xyz", "uvw")])
    held = right.select(F.col("i").alias("j"), *[F.col(a).alias(f"{a}2") for a in "xyz"], *[cell(a).alias(c) for a, c in zip("xyz", "uvw")])
    square = sum(((F.col(a) - F.col(f"{a}2")) * (F.col(a) - F.col(f"{a}2")) for a in "xyz"), F.lit(0.0))
    return asked.join(held, ["u", "v", "w"]).where("i <> j").select("i", "j", F.sqrt(square).alias("d")).where(F.col("d") <= radius)


def radius_counts(points: DataFrame, radii: Sequence[float]) -> DataFrame:
    """(i, r<radius>...): how many other points lie within each radius."""
    pairs = _near_pairs(points, points, max(radii))
    counts = pairs.groupBy("i").agg(*[F.count_if(F.col("d") <= r).alias(f"c{k}") for k, r in enumerate(radii)])
    return points.select("i").join(counts, "i", "left").select("i", *[F.coalesce(f"c{k}", F.lit(0).cast("long")).alias(f"r{r:g}") for k, r in enumerate(radii)])


def nearest_means(points: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(i, k<k>...): mean distance to the k nearest other points, or to all others where there are fewer, NULL for a lone point."""
    points = stored(points.select("i", "x", "y", "z"), "points")
    box = points.agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in "xyz"]).first()  # one row
    most = min(max(ks), max(box.n - 1, 0))
    span = [s for s in (box.x, box.y, box.z) if s]
    radius = (math.prod(span) * FIRST_SHELL / box.n) ** (1 / len(span)) if span else 1.0
    out, todo = None, points
    while most:
        ranked = _near_pairs(todo, points, radius).withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("n") <= max(ks))
        sums = ranked.groupBy("i").agg(F.count("*").alias("have"), *[F.avg(F.when(F.col("n") <= k, F.col("d"))).alias(f"k{k}") for k in ks])
        done = stored(sums.where(F.col("have") >= most).drop("have"), "shell")
        out = done if out is None else out.unionByName(done)
        todo = stored(todo.join(done, "i", "left_anti"), "shell-left")
        if not todo.limit(1).count():
            break
        radius *= 2
    if out is None:
        return points.select("i", *[F.lit(None).cast("double").alias(f"k{k}") for k in ks])
    return points.select("i").join(out, "i", "left")


def crowding(points: DataFrame, ks: Sequence[int] = (5, 10, 20), radii: Sequence[float] = (2.0, 5.0, 10.0), prefix: str = "eng.nucl") -> DataFrame:
    """(i, density, radius and centroid columns) of every point."""
    centre = points.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    square = sum(((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in "xyz"), F.lit(0.0))
    far = points.join(F.broadcast(centre)).select("i", F.sqrt(square).alias(f"{prefix}.xyz.from_centroid"))  # one row
    near, counts = nearest_means(points, ks), radius_counts(points, radii)
    named = near.select("i", *[F.col(f"k{k}").alias(f"{prefix}.density.k{k}") for k in ks]).join(counts.select("i", *[F.col(f"`r{r:g}`").cast("double").alias(f"{prefix}.radius.r{r:g}") for r in radii]), "i")
    return named.join(far, "i")


def contact_block(contacts: DataFrame, n: int, short: int, reach: int, prefix: str = "eng.nucl") -> DataFrame:
    """(i, total, short, long, their log ratio, insulation) of every bin 0..n-1 of a circular contact map (i, j, v)."""
    apart = F.pmod(F.col("j") - F.col("i"), F.lit(n))
    v, side = F.col("v"), F.least(apart, n - apart)
    when = lambda c: F.sum(F.when(c, v).otherwise(0.0))
    sums = contacts.groupBy("i").agg(
        F.sum(v).alias("total"), when(side <= short).alias("short"), when(apart.between(1, reach)).alias("right"), when((n - apart).between(1, reach)).alias("left")
    )
    every = contacts.sparkSession.range(n).withColumnRenamed("id", "i").join(sums, "i", "left").na.fill(0.0)
    right, left = F.col("right"), F.col("left")
    made = {
        "contacts.total": F.col("total"), "contacts.short": F.col("short"), "contacts.long": F.col("total") - F.col("short"),
        "contacts.short_long_log2": F.log2((F.col("short") + 1) / (F.col("total") - F.col("short") + 1)), "insulation": F.coalesce(F.try_divide(right - left, right + left), F.lit(0.0)),
    }
    return every.select("i", *[c.alias(f"{prefix}.{name}") for name, c in made.items()])


def _marginal(contacts: DataFrame, n: int, name: str) -> DataFrame:
    """(i, share of the map's sum); a sum below 1 counts as 1."""
    rows = contacts.groupBy("i").agg(F.sum("v").alias("s"))
    total = rows.agg(F.greatest(F.coalesce(F.sum("s"), F.lit(0.0)), F.lit(1.0)).alias("all"))
    every = contacts.sparkSession.range(n).withColumnRenamed("id", "i").join(rows, "i", "left")
    return every.join(F.broadcast(total)).select("i", (F.coalesce("s", F.lit(0.0)) / F.col("all")).alias(name))  # one row


def dependence(mutants: Mapping[str, tuple[DataFrame, DataFrame]], n: int, prefix: str = "eng.nucl.dep") -> DataFrame:
    """(i, one column a name): log2 ratio of a bin's share of the reference map to its share of the mutant's; maps (i, j, v)."""
    out = None
    for name, (mutant, reference) in mutants.items():
        both = _marginal(reference, n, "r").join(_marginal(mutant, n, "m"), "i")
        part = both.select("i", F.log2((F.col("r") + 1e-9) / (F.col("m") + 1e-9)).alias(f"{prefix}.{name}"))
        out = part if out is None else out.join(part, "i")
    return out


def by_place(rows: DataFrame, bins: DataFrame, key: str, place: Column, size: int, n: int, prefix: str = "eng.nucl") -> DataFrame:
    """(key, bin, bins' columns, offset in the bin) by a 1-based place; NULLs where there is none (JN-18)."""
    bin_ = F.pmod(F.floor((place - 1) / size), F.lit(n))
    asked = rows.select(key, bin_.alias("i"), (F.pmod(place - 1, F.lit(size)) / F.lit(size)).alias(f"{prefix}.offset_in_bin"))
    return asked.join(bins, "i", "left").withColumnRenamed("i", f"{prefix}.bin")
