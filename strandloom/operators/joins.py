"""Join operators (JN-*). Equi-joins are left to Catalyst; what it would plan as a nested loop is blocked here."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def left_blocks(base: DataFrame, key: str, blocks: Sequence[DataFrame]) -> DataFrame:
    """Base rows with the columns of every block, NULL where a block lacks the key (JN-01, JN-02, JN-04)."""
    for block in blocks:
        base = base.join(block, key, "left")
    return base


def flag_members(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """``member`` is true where the key is in the other table (JN-07)."""
    return df.join(members.select(key).distinct().withColumn("__in", F.lit(True)), key, "left").withColumn("member", F.coalesce("__in", F.lit(False))).drop("__in")


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose keys are not done (JN-08, ML-11, STM-00)."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def paired_deltas(cube: DataFrame, keys: Sequence[str], arm: str, value: str, baseline: str) -> DataFrame:
    """Every other arm's value minus the baseline's, on equal keys (JN-05, JN-06)."""
    base = cube.where(F.col(arm) == baseline).select(*keys, F.col(value).alias("base"))
    return cube.where(F.col(arm) != baseline).join(base, list(keys)).select(*keys, arm, (F.col(value) - F.col("base")).alias("delta"))


def interval_containment(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: int, group: Sequence[str] = ()) -> DataFrame:
    """Points with every interval [low, high] that holds them (JN-12).

    Both sides are cut into bins of ``width``: an interval is repeated for the bins it touches, a point has one, so the
    range join becomes an equi-join on the bin that shuffles by it.
    """
    bin_of = lambda c: F.floor(F.col(c) / width)
    left = points.withColumn("__bin", bin_of(point))
    right = intervals.withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    return left.join(right, [*group, "__bin"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def first_containing(found: DataFrame, key: str, low: str, *ties: str) -> DataFrame:
    """Of a point's intervals the one that starts last, equals by the smallest ``ties``."""
    best = Window.partitionBy(key).orderBy(F.desc(low), *ties)
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def nearest_on_line(points: DataFrame, targets: DataFrame, key: str, position: str, circle: int | None = None, size: int = 4096) -> DataFrame:
    """(key, position, before, after): distances to the nearest target at or below and at or above (JN-11, JN-13, JN-14).

    Each distinct position is searched once. Positions are cut into blocks of ``size``; each block carries the last target before it and the first after it from
    a table of block edges, so every window stays in its block. On a circle of n positions the targets are repeated
    one turn on either side.
    """
    t = targets.select(F.col(position).cast("long").alias("p")).distinct()
    if circle:
        t = t.select(F.explode(F.array(F.col("p") - circle, F.col("p"), F.col("p") + circle)).alias("p"))
    block = F.floor(F.col("p") / size)
    asked = points.select(F.col(position).cast("long").alias("p")).distinct()
    both = t.select("p", F.lit(True).alias("t")).unionByName(asked.select("p", F.lit(False).alias("t"))).withColumn("b", block)
    edges = both.groupBy("b").agg(F.min(F.when(F.col("t"), F.col("p"))).alias("first"), F.max(F.when(F.col("t"), F.col("p"))).alias("last"))
    # One row a block of positions; bounded by the extent of the axis over ``size``.
    edges = edges.select(
        "b", F.last("last", ignorenulls=True).over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.last("first", ignorenulls=True).over(Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"),
    )
    # Both frames grow with the scan; one that runs to the end would be read again for every row.
    up, down = (Window.partitionBy("b").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("p"), F.desc("p")))
    at = F.when(F.col("t"), F.col("p"))
    ranked = both.withColumn("lo", F.last(at, ignorenulls=True).over(up)).withColumn(
        "hi", F.last(at, ignorenulls=True).over(down)
    )
    found = ranked.where(~F.col("t")).join(edges, "b").select("p", (F.col("p") - F.coalesce("lo", "earlier")).alias("before"), (F.coalesce("hi", "later") - F.col("p")).alias("after"))
    own = points.select(F.col(key).cast("long").alias(key), F.col(position).cast("long").alias("p"))
    return own.join(found, "p").select(key, F.col("p").alias(position), "before", "after")


def hamming_texts(left: DataFrame, right: DataFrame, text: str, length: int, within: int) -> DataFrame:
    """(l, r, mismatches) of the distinct texts of two tables, ``length`` letters each, within ``within`` mismatches (JN-15).

    Pigeonhole blocking: cut into within + 2 pieces, two such texts share two pieces at their places, so an equi-join on
    (pair of places, both pieces) finds every pair. A pair is kept at the first two pieces it shares, so none comes twice and no
    distinct is needed; copies of a text are joined back by its text. For texts of A, C, G, T see ``offtarget.within``.
    """
    pieces = min(within + 2, length)
    take = pieces - within  # shared pieces at least
    if take < 1:
        raise ValueError("too many mismatches for the length")
    cuts = [round(i * length / pieces) for i in range(pieces + 1)]
    spans = list(zip(cuts, cuts[1:]))
    places = list(itertools.combinations(range(pieces), take))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        part = lambda i: F.substring(name, spans[i][0] + 1, spans[i][1] - spans[i][0])
        keys = F.array(*[F.struct(F.lit(n).alias("place"), F.concat(*[part(i) for i in held]).alias("piece")) for n, held in enumerate(places)])
        return df.select(F.col(text).alias(name)).distinct().withColumn("x", F.explode(keys)).select(name, "x.*")

    shared = [F.substring("l", a + 1, b - a) == F.substring("r", a + 1, b - a) for a, b in spans]
    first = F.lit(-1)
    for n, held in reversed(list(enumerate(places))):
        first = F.when(reduce(lambda x, y: x & y, [shared[i] for i in held]), n).otherwise(first)
    pairs = keyed(left, "l").join(keyed(right, "r"), ["place", "piece"]).where(F.col("place") == first)
    differ = F.expr(f"size(filter(sequence(1, {length}), i -> substr(l, i, 1) <> substr(r, i, 1)))")
    return pairs.select("l", "r", differ.alias("mismatches")).where(F.col("mismatches") <= within)


def neighbours(df: DataFrame, key: str, vector: str, k: int, radius: float, group: str | None = None, tile: int = 8192) -> DataFrame:
    """(key, mean_near, within): mean distance to the k nearest other rows and number within the radius (JN-16).

    Over all rows, or over those of one ``group``. Rows are dealt into tiles by a hash; each pair of tiles is one
    bounded task that multiplies matrices and sends k rows and one count a row, never its pairs. The products grow with
    the square of the rows, as the operator asks; equal distances go to the lesser key. A row alone in its group, or whose
    vector is NULL or has NULL or NaN components or another length than its neighbours', has no neighbour: (NULL, 0).
    """
    g = F.lit(0) if group is None else F.col(group)
    every = df.select(g.alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    rows = every.where(usable).withColumn("g", F.struct(F.col("g"), F.size("v").alias("length")))
    tiles = rows.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = rows.join(tiles, "g").withColumn("a", F.pmod(F.xxhash64("k"), F.col("tiles").cast("long")).cast("int"))
    cells = dealt.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "g", "k", "v", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") <= F.col("b")).alias("first")
    )

    # The greatest square whose root is within the radius.
    most = radius * radius if radius >= 0 else -np.inf
    while 0 <= most < np.inf and np.sqrt(np.nextafter(most, np.inf)) <= radius:
        most = np.nextafter(most, np.inf)
    while most > 0 and np.sqrt(most) > radius:
        most = np.nextafter(most, 0)

    def near(left: np.ndarray, right: np.ndarray, own: np.ndarray, other: np.ndarray) -> list[pa.Table]:
        out, lengths, turned = [], (right * right).sum(axis=1)[None, :], -2 * right.T
        for s in range(0, len(left), 128):
            x, ids = left[s : s + 128], own[s : s + 128]
            square = (x * x).sum(axis=1)[:, None] + lengths
            square += x @ turned
            square[ids[:, None] == other[None, :]] = np.inf
            within = (square <= most).sum(axis=1)
            # Only the k nearest of a row and their equals are sorted.
            last = np.partition(square, k - 1, axis=1)[:, k - 1 : k] if square.shape[1] > k else np.inf
            i, j = np.nonzero(np.isfinite(square) & ~(square > last))
            distance = np.sqrt(np.maximum(square[i, j], 0))
            order = np.lexsort((other[j], distance, i))
            i, j, distance = i[order], j[order], distance[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, distance, place = (y[place < k] for y in (i, j, distance, place))
            out.append(pa.table({"k": ids[i], "o": other[j], "d": distance, "within": np.where(place == 0, within[i], 0)}))
        return out

    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = table.column("k").to_numpy(), np.stack(table.column("v").to_numpy(zero_copy_only=False))
        same = table.column("a")[0] == table.column("b")[0]
        theirs = first if same else ~first
        parts = near(x[first], x[theirs], ids[first], ids[theirs]) if theirs.any() and first.any() else []
        parts += near(x[theirs], x[first], ids[theirs], ids[first]) if theirs.any() and first.any() and not same else []
        empty = pa.table({"k": ids[:0], "o": ids[:0], "d": np.zeros(0), "within": ids[:0]})
        return pa.concat_tables([empty, *parts])

    # A pair's work is far beyond its bytes, so pairs are dealt by an explicit number, which is not lowered for small ones.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(parts, "g", "a", "b").groupBy("g", "a", "b").applyInArrow(run, "k long, o long, d double, within long")
    # At most k rows a row and tile.
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("d", "o")))
    sums = ranked.groupBy("k").agg(F.avg(F.when(F.col("n") <= k, F.col("d"))).alias("mean_near"), F.sum("within").alias("within"))
    return every.select("k").join(sums, "k", "left").select(F.col("k").alias(key), "mean_near", F.coalesce("within", F.lit(0)).alias("within"))


def bin_lookup(df: DataFrame, position: str, width: int, table: DataFrame, n_bins: int) -> DataFrame:
    """Rows with the columns of their position's bin, on a circle of bins (JN-18)."""
    return df.withColumn("bin", F.pmod(F.floor((F.col(position) - 1) / width), F.lit(n_bins))).join(table, "bin", "left")


def fingerprint_match(columns: DataFrame, candidates: DataFrame) -> DataFrame:
    """Tidy (col, row, bit) tables matched by a digest of their whole contents, ambiguity reported (JN-19).

    The digest is the number of rows and two sums of hashes of (row, bit), which need no order and no column in one task.
    """

    def digests(df: DataFrame, name: str) -> DataFrame:
        hashed = lambda seed: F.sum(F.xxhash64("row", "bit", F.lit(seed)).cast("decimal(38,0)"))
        sums = df.groupBy("col").agg(F.count("*").alias("n"), hashed(1).alias("h1"), hashed(2).alias("h2"))
        return sums.select(F.col("col").alias(name), F.struct("n", "h1", "h2").alias("digest"))

    found = digests(columns, "col").join(digests(candidates, "candidate"), "digest", "left")
    return found.groupBy("col").agg(F.min("candidate").alias("candidate"), F.count("candidate").alias("matches")).withColumn("ambiguous", F.col("matches") > 1)


def lookup_profile(df: DataFrame, key: str, text: str, k: int, lookup: DataFrame, pattern: str = ".*") -> DataFrame:
    """(key, pos, kmer, value) of every k-letter window, NULL where the lookup (kmer, value) lacks it (JN-09, SC-08)."""
    windows = F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    rows = df.select(key, F.posexplode(windows).alias("p", "kmer")).select(key, (F.col("p") + 1).alias("pos"), "kmer")
    return rows.join(lookup, "kmer", "left").select(key, "pos", "kmer", "value")


def occurrences(queries: DataFrame, sites: DataFrame, text: str, order: Sequence[str] = ("strand", "pos")) -> DataFrame:
    """Every site with the query's text, how many there are and which comes first in ``order`` (JN-10).

    One row a match; a query without a match has one row with NULL sites and 0 copies.
    """
    counted = sites.groupBy(text).agg(F.count("*").alias("copies"), F.min(F.struct(*order)).alias("__first"))
    found = queries.join(counted, text, "left").join(sites, text, "left")
    return found.withColumn("copies", F.coalesce("copies", F.lit(0))).withColumn("first", F.struct(*order) == F.col("__first")).drop("__first")


def _nearest_of(points: DataFrame, targets: DataFrame, key: str, position: str) -> DataFrame:
    """(key, distance, number): the nearest target (position, number) of each point, the least number of equals."""
    lowest = targets.groupBy(F.col(position).cast("long").alias("__p")).agg(F.min("number").alias("number"))
    near = nearest_on_line(points, targets, key, position).withColumn("distance", F.least("before", "after"))
    ends = F.array(F.when(F.col("before") == F.col("distance"), F.col(position) - F.col("distance")), F.when(F.col("after") == F.col("distance"), F.col(position) + F.col("distance")))
    asked = near.select(key, "distance", F.explode(ends).alias("__p")).where("__p IS NOT NULL")
    return asked.join(lowest, "__p").groupBy(key, "distance").agg(F.min("number").alias("number"))


def nearest_interval(points: DataFrame, intervals: DataFrame, key: str, position: str, low: str, high: str, number: str, width: int = 4096) -> DataFrame:
    """(key, distance, number) of the interval nearest to each point, 0 inside; of equals the least number (JN-13).

    Every distinct position is searched once.
    """
    own = intervals.select(F.col(low).cast("long").alias("__low"), F.col(high).cast("long").alias("__high"), F.col(number).alias("number"))
    rows = points.select(key, F.col(position).cast("long").alias(position))
    at = rows.select(position, F.col(position).alias("__at")).distinct()
    inside = interval_containment(at, own, position, "__low", "__high", width).groupBy("__at").agg(F.min("number").alias("__in"))
    ends = own.select(F.col("__low").alias(position), "number").unionByName(own.select(F.col("__high").alias(position), "number"))
    joined = _nearest_of(at, ends, "__at", position).join(inside, "__at", "left")
    found = joined.select(F.col("__at").alias(position), F.when(F.col("__in").isNotNull(), 0).otherwise(F.col("distance")).alias("distance"), F.coalesce("__in", "number").alias("number"))
    return rows.join(found, position).select(key, "distance", "number")


def nearest_midpoint(points: DataFrame, intervals: DataFrame, key: str, position: str, low: str, high: str, number: str) -> DataFrame:
    """(key, distance, number) of the interval whose midpoint is nearest to each point, the least number of equals (JN-14)."""
    twice = intervals.select((F.col(low) + F.col(high)).cast("long").alias(position), F.col(number).alias("number"))
    rows = points.select(key, (2 * F.col(position)).cast("long").alias(position))
    at = rows.select(position, F.col(position).alias("__at")).distinct()
    found = _nearest_of(at, twice, "__at", position).select(F.col("__at").alias(position), (F.col("distance") / 2).alias("distance"), "number")
    return rows.join(found, position).select(key, "distance", "number")


def zip_rows(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows side by side by an explicit index (JN-20, SO-02)."""
    return left.join(right, order)


def anchor(df: DataFrame, key: str, fragment: Column, sequence: Column, reverse: Column) -> DataFrame:
    """1-based place of a fragment in a sequence on either strand; rows without one drop (JN-17)."""
    forward, backward = F.call_function("instr", sequence, fragment), F.call_function("instr", sequence, reverse)
    placed = df.select(key, F.when(forward > 0, F.lit("+")).when(backward > 0, F.lit("-")).alias("strand"), F.when(forward > 0, forward).otherwise(backward).alias("place"))
    return placed.where("place > 0")
