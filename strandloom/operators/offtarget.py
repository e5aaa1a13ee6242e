"""Off-target search over packed letters (JN-15, FF-H), all of it in column expressions.

A text of A, C, G, T is one 64-bit number, two bits a letter, so texts have at most 31 letters; mismatches are the bit count of
an exclusive-or folded by pairs. Two texts of L letters within m mismatches agree in two at least of m + 2 pieces, so a join on
(pair of pieces, letters of both) finds every such pair; a pair of texts is kept at the first two pieces they share, so
none comes twice. Sites are counted by their distinct text first. A query's nearest site beyond m is found by growing
the radius for the queries that have none yet, and for those left after the last radius by comparing blocks of queries
with blocks of sites, a bounded task each, which sends one row a query.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.sources.workspace import stored

#: Texts of a block in the last comparison.
BLOCK = 8192


def packed(text: Column, length: int) -> Column:
    """The text's letters as a number, NULL unless it has ``length`` letters of A, C, G, T."""
    digits = F.translate(text, "ACGT", "0123")
    return F.when(text.rlike(f"^[ACGT]{{{length}}}$"), F.conv(digits, 4, 10).cast("long"))


def mismatches(a: Column, b: Column) -> Column:
    """Letters in which two packed texts differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))


def _spans(length: int, pieces: int) -> list[tuple[int, int]]:
    """(mask, shift) of each of ``pieces`` runs of letters."""
    cuts = [2 * round(i * length / pieces) for i in range(pieces + 1)]
    return [(((1 << b - a) - 1) << a, a) for a, b in zip(cuts, cuts[1:])]


def within(queries: DataFrame, sites: DataFrame, length: int, most: int) -> DataFrame:
    """(q, s, mm) of the distinct packed texts ``q`` and ``s`` of two tables that differ in ``most`` letters or fewer."""
    spans = _spans(length, most + 2)
    if len(spans) > length:
        raise ValueError("too many mismatches for the length")
    pairs = list(itertools.combinations(range(len(spans)), 2))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        part = lambda i: F.shiftright(F.col(name).bitwiseAND(F.lit(spans[i][0])), spans[i][1])
        keys = [F.struct(F.lit(n).alias("pair"), part(i).alias("one"), part(j).alias("two")) for n, (i, j) in enumerate(pairs)]
        return df.select(name).distinct().select(name, F.inline(F.array(*keys)))

    x = F.col("q").bitwiseXOR(F.col("s"))
    same = [x.bitwiseAND(F.lit(mask)) == 0 for mask, _ in spans]
    # Among pairs of pieces in their order, the first two shared pieces come first.
    first = F.lit(-1)
    for n, (i, j) in reversed(list(enumerate(pairs))):
        first = F.when(same[i] & same[j], n).otherwise(first)
    met = keyed(queries, "q").join(keyed(sites, "s"), ["pair", "one", "two"]).where(F.col("pair") == first)
    return met.select("q", "s", mismatches(F.col("q"), F.col("s")).cast("int").alias("mm")).where(F.col("mm") <= most)


def nearest_by_blocks(queries: DataFrame, sites: DataFrame) -> DataFrame:
    """(q, least): fewest mismatches above 0 of each packed query, by blocks of exclusive-ors."""
    n_q, n_s = (max(1, -(-df.count() // BLOCK)) for df in (queries, sites))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(F.col("q").alias("x"), part("q", n_q).alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_s - 1)))).withColumn("query", F.lit(True))
    right = sites.select(F.col("s").alias("x"), part("s", n_s).alias("b")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("query", F.lit(False))

    def run(table: pa.Table) -> pa.Table:
        x, query = table.column("x").to_numpy().view(np.uint64), table.column("query").to_numpy(zero_copy_only=False)
        q, s = x[query], x[~query]
        best = np.full(len(q), 255, dtype=np.uint8)
        for at in range(0, len(s), 512):
            apart = q[:, None] ^ s[None, at : at + 512]
            count = np.bitwise_count((apart | apart >> np.uint64(1)) & np.uint64(0x5555555555555555))
            count[count == 0] = 255
            np.minimum(best, count.min(axis=1), out=best)
        found = best < 255
        return pa.table({"q": q[found].view(np.int64), "least": best[found].astype(np.int32)})

    both = left.select("x", "a", "b", "query").unionByName(right.select("x", "a", "b", "query"))
    return both.groupBy("a", "b").applyInArrow(run, "q long, least int").groupBy("q").agg(F.min("least").alias("least"))


def off_targets(
    queries: DataFrame, sites: DataFrame, key: str = "key", text: str = "s", length: int = 20, most: int = 4, seed: int = 12, radii: Sequence[int] = (6,), prefix: str = "eng.offt",
) -> DataFrame:
    """Copies, sites by mismatches, seed-exact ones, nearest other site and burden of every query (FF-H).

    ``seed`` letters at the end make the seed. Copies are sites with the query's own text, which weigh nothing in the burden
    and are no nearest site. A query without a site in reach has zeros, one that is no text of ``length`` letters A, C, G, T
    NULLs throughout; such sites are left out. ``min_mismatch`` is NULL where all sites are copies or there are none.
    """
    asked = stored(queries.select(key, packed(F.col(text), length).alias("q")), "offtarget-queries")
    # Equal texts are counted before they are packed, so a text is made once a site and read as letters once a distinct text.
    counted = sites.groupBy(F.col(text).alias("s")).agg(F.count("*").alias("n"))
    held = stored(counted.select(packed(F.col("s"), length).alias("s"), "n"), "offtarget-sites").where("s IS NOT NULL")
    distinct = asked.where("q IS NOT NULL").select("q").distinct()
    found = stored(within(distinct, held, length, most), "offtarget-pairs").join(held, "s")
    in_seed = F.col("q").bitwiseXOR(F.col("s")).bitwiseAND(F.lit((1 << 2 * seed) - 1)) == 0
    at = lambda k, more=F.lit(True): F.sum(F.when((F.col("mm") == k) & more, F.col("n")).otherwise(0))
    sums = found.groupBy("q").agg(
        at(0).alias("copies"), *[c for k in range(1, most + 1) for c in (at(k).alias(f"mm{k}"), at(k, in_seed).alias(f"seed_exact_mm{k}"))],
        F.min(F.when(F.col("mm") > 0, F.col("mm"))).alias("least"),
    )
    near = sums.where("least IS NOT NULL").select("q", "least")
    todo = stored(distinct.join(near, "q", "left_anti"), "offtarget-left")
    for radius in radii:
        wider = stored(within(todo, held, length, radius).where("mm > 0").groupBy("q").agg(F.min("mm").alias("least")), "offtarget-wider")
        near, todo = near.unionByName(wider), stored(todo.join(wider, "q", "left_anti"), "offtarget-left")
    near = near.unionByName(nearest_by_blocks(todo, held.select("s")))
    per_query = distinct.join(sums.drop("least"), "q", "left").join(near, "q", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    counts = {"copies": zero("copies")} | {f"{c}{k}": zero(f"{c}{k}") for k in range(1, most + 1) for c in ("mm", "seed_exact_mm")}
    burden = sum((zero(f"mm{k}") * F.lit(4.0**-k) for k in range(1, most + 1)), F.lit(0.0))
    made = counts | {
        "le3": sum((zero(f"mm{k}") for k in range(1, min(3, most) + 1)), F.lit(0).cast("long")), "min_mismatch": F.col("least").cast("long"), "weighted_burden": burden,
        "multi_copy": (zero("copies") > 1).cast("long"),
    }
    block = per_query.select("q", *[c.alias(f"{prefix}.{n}") for n, c in made.items()])
    return asked.join(block, "q", "left").select(key, *[F.col(f"`{prefix}.{n}`") for n in made])
