"""Redundancy, headroom and importance reports (ML-23, 25, 27..33, 38, 39, 42) on tidy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.operators.aggregates import pair_sums, spearman_by


def column_correlations(profile: DataFrame) -> DataFrame:
    """(i, j, r) of every two columns i < j of a tidy (id, pos, v): over the rows that have both, 0 for constants (ML-28, ML-31)."""
    own = profile.where("v IS NOT NULL").withColumn("__g", F.lit(0))
    # Values far from zero are moved first, so that sums of products keep their digits.
    means = own.groupBy("pos").agg(F.avg("v").alias("__m"))
    moved = own.join(F.broadcast(means), "pos").withColumn("v", F.col("v") - F.col("__m"))  # one row a column
    sums = pair_sums(moved, "__g", "id", "pos", "v").where("i < j")
    n = F.col("n")
    spread = lambda x, xx: F.sqrt(F.greatest(F.col(xx) / n - F.pow(F.col(x) / n, F.lit(2)), F.lit(0.0)))
    covariance = F.col("s") / n - F.col("x") / n * F.col("y") / n
    return sums.select("i", "j", F.coalesce(F.try_divide(covariance, spread("x", "xx") * spread("y", "yy")), F.lit(0.0)).alias("r"))


def nearest_correlate(correlations: DataFrame) -> DataFrame:
    """(col, nearest, size): each column's strongest partner, the first of ties (ML-28)."""
    both = correlations.unionByName(correlations.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    best = F.max_by(F.struct("j", F.abs("r").alias("size")), F.struct(F.abs("r").alias("s"), (-F.col("j")).alias("t")))
    return both.groupBy(F.col("i").alias("col")).agg(best.alias("b")).select("col", F.col("b.j").alias("nearest"), "b.size")


def cross_correlations(left: DataFrame, right: DataFrame, columns: int = 512) -> DataFrame:
    """(i, j, r) of every column of one tidy table (id, pos, v) with every column of another, over the ids that have both (ML-28).

    The right table's positions are moved behind the left's, into blocks of their own; only blocks of both are multiplied.
    """
    top = left.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("m")).first().m  # one row
    first = (int(top) // columns + 1) * columns
    centred = lambda df: df.where("v IS NOT NULL").join(F.broadcast(df.groupBy("pos").agg(F.avg("v").alias("__m"))), "pos").select("id", "pos", (F.col("v") - F.col("__m")).alias("v"))  # noqa: E731  one row a column
    both = centred(left).unionByName(centred(right).withColumn("pos", F.col("pos") + first)).withColumn("__g", F.lit(0))
    sums = pair_sums(both, "__g", "id", "pos", "v", columns, crossed=first // columns)
    n = F.col("n")
    spread = lambda x, xx: F.sqrt(F.greatest(F.col(xx) / n - F.pow(F.col(x) / n, F.lit(2)), F.lit(0.0)))
    covariance = F.col("s") / n - F.col("x") / n * F.col("y") / n
    return sums.select("i", (F.col("j") - first).alias("j"), F.coalesce(F.try_divide(covariance, spread("x", "xx") * spread("y", "yy")), F.lit(0.0)).alias("r"))


def nearest_with_null(left: DataFrame, right: DataFrame, seed: int, columns: int = 512) -> DataFrame:
    """(col, nearest, size, null_size): each left column's strongest right column, the first of ties, and how strong the strongest
    is when the left rows are dealt anew to the ids by md5 (ML-28)."""
    from strandloom.operators.resampling import permuted

    ids = left.select("id").distinct()
    moved = permuted(ids.withColumn("from", F.col("id")), "id", ["from"], seed)
    shuffled = moved.join(left.withColumnRenamed("id", "from"), "from").select("id", "pos", "v")
    best = F.max_by(F.struct("j", F.abs("r").alias("size")), F.struct(F.abs("r").alias("s"), (-F.col("j")).alias("t")))
    own = cross_correlations(left, right, columns).groupBy(F.col("i").alias("col")).agg(best.alias("b")).select("col", F.col("b.j").alias("nearest"), "b.size")
    null = cross_correlations(shuffled, right, columns).groupBy(F.col("i").alias("col")).agg(F.max(F.abs("r")).alias("null_size"))
    return own.join(null, "col", "left")


def greedy_clusters(correlations: DataFrame, order: Sequence[int], tau: float) -> dict[int, int]:
    """Column -> cluster seed: columns in order take all free columns correlated at ``tau`` or more (ML-29).

    Only the pairs at or above ``tau`` come to the driver; columns are few against rows.
    """
    near: dict[int, set[int]] = {}
    for r in correlations.where(F.abs("r") >= tau).select("i", "j").collect():
        near.setdefault(r.i, set()).add(r.j)
        near.setdefault(r.j, set()).add(r.i)
    seed: dict[int, int] = {}
    for c in order:
        if c not in seed:
            for m in {c} | near.get(c, set()):
                seed.setdefault(m, c)
    return seed


def headroom(profile: DataFrame, residuals: DataFrame, least: int = 200) -> DataFrame:
    """(pos, n, rho): rank correlation of every column with the residual (id, e), complete rows only, constants left out (ML-32)."""
    rows = profile.join(residuals, "id").where("v IS NOT NULL AND e IS NOT NULL")
    varied = rows.groupBy("pos").agg(F.count("*").alias("c"), F.count_distinct("v").alias("d")).where((F.col("c") >= least) & (F.col("d") > 1)).select("pos")
    return spearman_by(rows.join(F.broadcast(varied), "pos"), ["pos"], "v", "e")  # one row a column


def linear_attribution(profile: DataFrame, weights: DataFrame) -> DataFrame:
    """(pos, importance): mean size of each column's share of a linear prediction, |w| times the mean distance to the mean (ML-25)."""
    means = profile.groupBy("pos").agg(F.avg("v").alias("m"))
    centred = profile.join(F.broadcast(means), "pos")  # one row a column
    spread = centred.groupBy("pos").agg(F.avg(F.abs(F.col("v") - F.col("m"))).alias("s"))
    return spread.join(F.broadcast(weights), "pos").select("pos", (F.abs("w") * F.col("s")).alias("importance"))  # one row a column


def importance_agreement(importances: DataFrame) -> DataFrame:
    """(a, b, rho) of every two models' importances (model, pos, value) (ML-27)."""
    other = importances.select(F.col("model").alias("b"), "pos", F.col("value").alias("y"))
    pairs = importances.select(F.col("model").alias("a"), "pos", F.col("value").alias("x")).join(other, "pos").where("a < b")
    return spearman_by(pairs, ["a", "b"], "x", "y").select("a", "b", "rho")


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows with another target; those without one are left out (ML-39)."""
    return df.join(labels.where(F.col(label).isNotNull()).select(key, label), key)


def stratified(df: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Rows once for each stratum that holds them (ML-38)."""
    held = F.array(*[F.when(c, F.lit(name)) for name, c in strata.items()])
    return df.withColumn("stratum", F.explode(F.filter(held, lambda x: x.isNotNull())))


def screen_disagreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, gap): difference of percentile ranks of two screens of one library (ML-33, WN-01)."""
    from strandloom.operators.ordering import average_rank

    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    n = both.agg(F.count("*").alias("n"))
    ranked = average_rank(average_rank(both, "a", "ra"), "b", "rb").join(F.broadcast(n))  # one row
    return ranked.select(key, ((F.col("ra") - F.col("rb")) / F.col("n")).alias("gap"))


def verify_folds(df: DataFrame, selected: DataFrame, key: str, fold: str, folds: int, k: int) -> DataFrame:
    """(check, failures): every key in one fold, no fold empty, each fold's selected set of k different items (ML-42, SO-06)."""
    keys = df.groupBy(key).agg(F.count_distinct(fold).alias("c")).where("c <> 1").agg(F.lit("key in one fold").alias("check"), F.count("*").alias("failures"))
    empty = df.agg(F.lit("no fold empty").alias("check"), (F.lit(folds) - F.count_distinct(fold)).alias("failures"))
    sets = selected.groupBy(fold).agg(F.count("*").alias("n"), F.count_distinct("item").alias("d")).where(f"n <> {k} OR d <> {k}").agg(F.lit("sets complete").alias("check"), F.count("*").alias("failures"))
    return keys.unionByName(empty).unionByName(sets)
