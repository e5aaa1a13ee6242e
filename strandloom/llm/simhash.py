"""SimHash near-duplicates by tiled exact comparison.

A text's words, A-Z lower-cased, form 3-word shingles; a fingerprint bit is set if it is set in over half of the
XXH64 hashes (seed 42) of the shingles, repeats included. Distinct fingerprints are binned by the population
counts of their two halves. Two fingerprints within ``radius`` bits lie in bins whose counts differ by no more
than the radius in sum, so all other tile pairs are skipped without loss; the tiles of the remaining pairs are
compared exactly with exclusive-or and bit counts. Large bins are split into tiles by a hash, each tile pair is
one bounded group, and a group gives a spanning forest of its links, not all pairs. Components then come from
distributed star contraction (``graph.py``).

Defined cases: a null, empty or word-free text has fingerprint zero and links like any other; fewer than three
words give one shingle of them all; ``component_id`` is the smallest non-null doc_id reachable (null if there is
none); repeated rows repeat their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strandloom.llm.common import fresh, map_columns, materialise, ship_package, texts_of
from strandloom.llm.graph import Forest, connected_components

#: Fingerprints a tile; a group holds two tiles at most.
TILE = 8192

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = np.arange(0, 2048, 256)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((h + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BITS) > len(hashes)).astype(np.uint8).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Append ``fp``, the fingerprint as a signed 64-bit integer; one pass, no shuffle."""

    def run(texts: pa.Array) -> list[pa.Array]:
        made = np.array([fingerprint(t) for t in texts_of(texts)], dtype=np.uint64)
        return [pa.array(made.view(np.int64))]

    return map_columns(docs, run, [T.StructField("fp", T.LongType())], [text_col], list(keep))


def _tiles(distinct: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, own tile, tile pair): each fingerprint once for every tile pair it takes part in."""
    spark = distinct.sparkSession
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    binned = distinct.withColumn("hi", high).withColumn("lo", F.bit_count("fp").cast("int") - high)
    # At most 33 * 33 rows, whatever the corpus.
    sizes = {(r.hi, r.lo): -(-r["count"] // TILE) for r in binned.groupBy("hi", "lo").count().collect()}
    pairs = []
    for (hi, lo), tiles in sizes.items():
        for dh in range(-radius, radius + 1):
            for dl in range(abs(dh) - radius, radius - abs(dh) + 1):
                there = (hi + dh, lo + dl)
                if there in sizes:
                    pairs.append((hi, lo, *there, tiles, sizes[there]))
    grid = spark.createDataFrame(pairs, "hi int, lo int, hi2 int, lo2 int, tiles int, tiles2 int")
    # A tile is compared with every tile of each near bin; of (x, y) and (y, x) the lower one is kept.
    mine = F.struct("hi", "lo", "tile")
    other = F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("tile2").alias("tile"))
    return (
        binned.join(F.broadcast(grid), ["hi", "lo"])  # at most 1089 * 13 rows
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles").cast("long")).cast("int"))
        .withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
        .select("fp", F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"), (mine <= other).alias("first"))
    )


def _near_in_group(radius: int):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        same = table.column("a")[0] == table.column("b")[0]  # a tile with itself: its rows come once, as first
        ours = np.flatnonzero(first)
        theirs = ours if same else np.flatnonzero(~first)
        forest = Forest(len(fp))
        for s in range(0, len(ours), 512):
            left, right = ours[s : s + 512], theirs[s:] if same else theirs
            i, j = np.nonzero(np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius)
            forest.link(left[i], right[j])
        a, b = forest.links()
        ids = fp.view(np.int64)
        return pa.table({"src": pa.array(ids[a], pa.int64()), "dst": pa.array(ids[b], pa.int64())})

    return run


def near_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Spanning links (src, dst) between distinct fingerprints within ``radius`` bits."""
    ship_package(distinct.sparkSession)
    tiles = _tiles(distinct, radius)
    return tiles.groupBy("a", "b").applyInArrow(_near_in_group(radius), "src long, dst long")


def simhash_components(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row."""
    marked = materialise(fingerprints(docs, text_col, (id_col,)), "fingerprints")
    # The smallest id of each distinct fingerprint; copies meet here and are not compared.
    distinct = materialise(marked.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("low")), "distinct")
    links = connected_components(near_links(distinct.select("fp"), radius))
    grouped = distinct.join(links, distinct.fp == links.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    roots = materialise(grouped.join(lows, "root").select("fp", "component_id"), "components")
    return marked.join(roots, "fp")


def keep_one(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, all columns unchanged.

    Of repeated rows of one id one stays; rows without an id stay where no row of their component has one,
    exact copies among them once.
    """
    key, row = fresh(docs, "kept"), fresh(docs, "row")
    kept = (
        simhash_components(docs, radius, id_col, text_col)
        .where(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id")))
        .select(F.col(f"`{id_col}`").alias(key))
        .distinct()
    )
    held = docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_semi")
    text_hash = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    one = Window.partitionBy(F.col(f"`{id_col}`"), F.when(F.col(f"`{id_col}`").isNull(), text_hash)).orderBy(text_hash)
    return held.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).drop(row)
