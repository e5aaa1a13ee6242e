"""Packing with optimal length buckets.

The lengths of all documents give one global histogram. Dynamic programming over it chooses at most
``buckets`` upper bounds that minimise the padding of all documents; inside a bucket, batches of as many documents
as the token budget holds at the bucket's bound are formed. Only DataFrame operations touch the rows. Ranks inside a
bucket come from row numbers in bounded shards plus prefix sums of the shards' counts, so no task sorts a whole
bucket and every bucket has at most one batch that is not full.

Lengths are words, and the histogram has one row for each distinct length: as d distinct lengths take d * d / 2 words
at least, a corpus of 10^13 words has less than 5 million of them.

Defined cases: a null or empty text has length 0; a document longer than the budget is a batch of its own; ties and
repeated rows are placed one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import WORD_RE, materialise

BUCKETS = 16
TOKEN_BUDGET = 16_384
#: Rows of a shard, in which ranks are numbered by one task.
SHARD_ROWS = 8_192


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending upper bounds, at most ``buckets``, with the least total padding.

    best[j] over the first j lengths is min_i best[i] + length[j] * (count of i..j); for each further bucket the
    lines of slope -count and the ascending lengths give all minima in one sweep of a lower hull.
    """
    n = len(lengths)
    if not n:
        return []
    cum = np.concatenate([[0], np.cumsum(counts)]).astype(object)
    size = [int(x) for x in lengths]
    best = [0] + [None] * n
    choice = []
    for _ in range(min(buckets, n)):
        new, back, hull = [0] + [None] * n, np.zeros(n + 1, dtype=np.int64), []
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                line = (-int(cum[j - 1]), best[j - 1], j - 1)
                while len(hull) - at >= 2 and _hides(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = size[j - 1]
            while len(hull) - at >= 2 and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            if len(hull) > at:
                m, c, i = hull[at]
                new[j], back[j] = m * x + c + int(cum[j]) * x, i
        choice.append(back)
        best = new
    bounds, j = [], n
    for back in reversed(choice):
        if j == 0:
            break
        bounds.append(size[j - 1])
        j = int(back[j])
    return bounds[::-1]


def _hides(a: tuple, b: tuple, c: tuple) -> bool:
    """True if line b is nowhere the lowest between a and c (slopes fall)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None) -> DataFrame:
    """(id, n_tokens, bucket, padded_tokens, batch, slot) of every row; ``batch`` is unique over all buckets."""
    n = word_count(F.col(f"`{text_col}`")) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    # The row number tells repeated rows apart, which else would share a shard.
    order = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.monotonically_increasing_id())
    sized = materialise(docs.select(F.col(f"`{id_col}`"), n.alias("n_tokens"), order.alias("__h")), "lengths")
    cells = sized.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()
    highs, counts = (cells.column(c).to_numpy() for c in ("n_tokens", "count"))
    bounds = optimal_bounds(highs, counts, buckets) or [0]
    at = np.searchsorted(bounds, highs) if len(highs) else np.zeros(0, dtype=int)
    shards = [max(1, -(-int(counts[at == k].sum()) // SHARD_ROWS)) for k in range(len(bounds))]

    def pick(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)

    bucket = F.lit(len(bounds) - 1)
    for k in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
    placed = (
        sized.withColumn("bucket", bucket.cast("int")).withColumn("padded_tokens", pick(bounds))
        .withColumn("__shard", F.pmod("__h", pick(shards)))
    )
    by_shard = Window.partitionBy("bucket", "__shard").orderBy("__h", F.col(f"`{id_col}`"), "n_tokens")
    before = Window.partitionBy("bucket").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        placed.groupBy("bucket", "__shard").count()
        .select("bucket", "__shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    )
    ranked = placed.withColumn("__n", F.row_number().over(by_shard)).join(base, ["bucket", "__shard"])
    rank = F.col("__base") + F.col("__n") - 1
    rows = pick([max(1, budget // max(b, 1)) for b in bounds])
    return ranked.select(
        F.col(f"`{id_col}`"), "n_tokens", "bucket", "padded_tokens",
        (F.col("bucket").cast("long") * (1 << 48) + F.floor(rank / rows)).alias("batch"), F.pmod(rank, rows).alias("slot"),
    )
