"""Near-duplicates by SimHash over 5-word shingles, links verified by the exact Jaccard similarity.

A text's words, A-Z lower-cased, form 5-word shingles; two texts are linked if their sets of shingles (64-bit hashes)
have a Jaccard similarity of 4/5 or more. Candidates come from operator 8's comparison in tiles: fingerprints of 256
bits, exclusive-or and bit counts, a link within a radius. The chance that a bit differs at a similarity of 0.8 depends on
the sets' sizes: 3/16 for 4 shingles against 5, at most 0.162 for larger ones. The radius is 84 bits for sets of 4 and
74 for larger ones, which loses a pair at the threshold with a chance below 1 in 1,000,000 at every size.

Texts with equal sets meet first and count once. Tiles are intervals of the sets' sizes, as similar sets differ by no
more than 5/4 in size; within a tile pair, blocks whose population counts differ beyond the radius are skipped. The
first round sends, for every text with candidates, one of them, near ones first; these are verified and give
components. Each next round compares the texts again and sends for each its nearest candidates in other components
that were not sent before and that parity bits do not exclude, which prove how many shingles two sets differ in at least:
one, one, eight, sixty-four and so on, until no text has more. So a group of near copies costs a few checks a
member, a round's pairs are bounded by its allotment a text, and no pair above the threshold is left out but for the radius.

Defined cases: a null, empty or word-free text has the shingle of no words, so these are copies of one another; fewer
than five words give one shingle of them all; ``component_id`` is the smallest non-null doc_id reachable (null if
there is none); repeated rows repeat their result; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strandloom.llm.common import discard, fresh, map_columns, materialise, ship_package, slices
from strandloom.llm.graph import connected_components

WIDTH = 5
#: Bits in which fingerprints of linked texts differ at most, of 64 * WORDS, in general and where a set has SMALL shingles or
#: fewer; and below which candidates are taken first.
RADIUS, SMALL_RADIUS, SMALL, WORDS, NEAR = 74, 84, 4, 4, 44
#: Candidates of a text in the rounds after the first; the last one grows by itself.
ALLOTMENTS = (1, 1, 8)
#: Pairs that a task holds before it keeps each text's nearest ones.
HELD_PAIRS = 1 << 20
#: Texts a tile; a group holds two tiles at most.
TILE = 16_384
#: Ratio of the sizes at the ends of a bin, a little over 5/4, so that similar sets lie in neighbouring bins.
RATIO = 1.26
#: Parity bits, at most.
PARITY_BITS = 1 << 15
#: Bits of the filter that texts pass before they are shuffled for verification.
FILTER_BITS = 27
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: pa.StringArray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every text, ascending, one text after another, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    held = pc.not_equal(flat, "")
    words = flat.filter(held).dictionary_encode()
    text = text[held.to_numpy(zero_copy_only=False)]
    digest = xxhash.xxh64_intdigest
    hashed = np.array([digest(w, 42) for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()], dtype=np.uint64)
    word = hashed[words.indices.to_numpy(zero_copy_only=False)] if len(text) else np.zeros(0, dtype=np.uint64)
    counts = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(counts)
    # A shingle starts at each word with enough words behind it, and at the first word of a shorter text.
    place = np.arange(len(word)) - np.repeat(ends - counts, counts)
    size = np.repeat(np.minimum(counts, width), counts)
    first = np.flatnonzero((place + size <= np.repeat(counts, counts)) & ((size == width) | (place == 0)))
    value = np.zeros(len(first), dtype=np.uint64)
    for k in range(width):
        inside = size[first] > k
        value[inside] = _mix(value[inside] + GOLDEN + word[first[inside] + k])
    empty = np.flatnonzero(counts == 0)
    value = np.concatenate([value, np.full(len(empty), GOLDEN)])
    of = np.concatenate([text[first], empty])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(texts) + 1))


def fingerprints(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One row of WORDS 64-bit numbers a text: a bit is set if it is in over half of the shingles."""
    n = len(begins) - 1
    counts = np.zeros((n, 64 * WORDS), dtype=np.int32)
    of = np.repeat(np.arange(n), np.diff(begins))
    for s in range(0, len(values), 1 << 15):
        part, text = values[s : s + (1 << 15)], of[s : s + (1 << 15)]
        spread = np.stack([_mix(part + np.uint64(k * int(GOLDEN) % 2**64)) for k in range(WORDS)], axis=1)
        bits = np.unpackbits(spread.view(np.uint8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        counts[text[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    bits = (2 * counts > np.diff(begins)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def parities(own: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the shingles fall on i; a power of two of bits, one or two a shingle."""
    bits = min(PARITY_BITS, max(64, 1 << len(own).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_differences(parity: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A proven lower bound of the number of shingles that each pair of sets does not share."""
    sizes = np.fromiter(map(len, parity), dtype=np.int64, count=len(parity))
    both = np.minimum(sizes[i], sizes[j])
    out = np.zeros(len(i), dtype=np.int64)
    for size in np.unique(both).tolist():
        pairs = np.flatnonzero(both == size)
        rows = np.unique(np.concatenate([i[pairs], j[pairs]]))
        # Longer parities fold onto shorter ones by exclusive-or.
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(parity[r], dtype=np.uint8).reshape(-1, size), axis=0) for r in rows.tolist()])
        for s in range(0, len(pairs), 65_536):
            p = pairs[s : s + 65_536]
            out[p] = np.bitwise_count(folded[np.searchsorted(rows, i[p])] ^ folded[np.searchsorted(rows, j[p])]).sum(axis=1)
    return out


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, key, n, fp, parity) of every row; ``key`` digests the whole set, ``hash`` the text."""

    def run(texts: pa.Array) -> list[pa.Array]:
        values, begins = shingle_sets(texts)
        spans = [values[s:e] for s, e in zip(begins.tolist(), begins[1:].tolist())]
        fps = fingerprints(values, begins)
        return [
            pa.array([xxhash.xxh3_128_digest(own.tobytes()) for own in spans], pa.binary()), pa.array(np.diff(begins), pa.int64()),
            pa.array([row.tobytes() for row in fps], pa.binary()), pa.array([parities(own) for own in spans], pa.binary()),
        ]

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    fields = [T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("parity", T.BinaryType())]
    return map_columns(named, run, fields, ["text"], ["id", "hash"])


def _tiles(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Each node once for every tile pair it takes part in; tiles are hashed parts of the bins of size."""
    binned = nodes.withColumn("bin", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(RATIO))).cast("int"))
    # One row a bin; the bins grow with the logarithm of the longest text.
    tiles = {r.bin: -(-r["count"] // TILE) for r in binned.groupBy("bin").count().collect()}
    near = [(a, b, tiles[a], tiles[b]) for a in tiles for b in (a - 1, a, a + 1) if b in tiles]
    grid = nodes.sparkSession.createDataFrame(near, "bin int, bin2 int, tiles int, tiles2 int")
    mine, other = F.struct("bin", "tile"), F.struct(F.col("bin2").alias("bin"), F.col("tile2").alias("tile"))
    return (
        binned.join(F.broadcast(grid), "bin")
        .withColumn("tile", F.pmod(F.xxhash64("rid"), F.col("tiles").cast("long")).cast("int"))
        .withColumn("tile2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
        .select(*columns, F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"), (mine <= other).alias("first"))
    )


def radius_of(n: np.ndarray) -> int:
    """The radius of a tile pair with sets of these sizes."""
    return SMALL_RADIUS if n.min(initial=SMALL + 1) <= SMALL else RADIUS


def near_pairs(fp: np.ndarray, n: np.ndarray, first: np.ndarray, same: bool, block: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, bits apart) of all rows of a tile pair within the radius whose sizes fit, in blocks; ``same`` a tile with itself."""
    count, radius = np.bitwise_count(fp).sum(axis=1, dtype=np.int64), radius_of(n)
    ours = np.flatnonzero(first)
    theirs = ours if same else np.flatnonzero(~first)
    ours, theirs = (x[np.argsort(count[x], kind="stable")] for x in (ours, theirs))
    ordered = count[theirs]
    for s in range(0, len(ours), block):
        left = ours[s : s + block]
        low = s if same else np.searchsorted(ordered, count[left[0]] - radius)
        right = theirs[low : np.searchsorted(ordered, count[left[-1]] + radius, side="right")]
        if not len(right):
            continue
        apart = np.zeros((len(left), len(right)), dtype=np.uint8)
        for k in range(WORDS - 1):
            apart += np.bitwise_count(fp[left, k][:, None] ^ fp[right, k][None, :])
        i, j = np.nonzero(apart <= radius)
        bits = apart[i, j].astype(np.int64)
        i, j = left[i], right[j]
        bits += np.bitwise_count(fp[i, -1] ^ fp[j, -1])
        held = (bits <= radius) & (i != j) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
        yield i[held], j[held], bits[held]


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    fp = np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype="<u8").reshape(-1, WORDS)
    first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
    return table.column("rid").to_numpy(), fp, table.column("n").to_numpy(), first, table.column("a")[0] == table.column("b")[0]


def _one_candidate(table: pa.Table) -> pa.Table:
    """For every row with candidates the least of those with a smaller number, near ones first; -1 if all are larger."""
    rid, fp, n, first, same = _columns(table)
    none = np.int64(2**63 - 1)
    best, some = np.full(len(rid), none), np.zeros(len(rid), dtype=bool)
    far = np.int64(1 << 62)
    for i, j, bits in near_pairs(fp, n, first, same):
        some[i] = some[j] = True
        low, high = np.where(rid[i] < rid[j], i, j), np.where(rid[i] < rid[j], j, i)
        np.minimum.at(best, high, rid[low] + np.where(bits > NEAR, far, 0))
    at = np.flatnonzero(some)
    return pa.table({"rid": rid[at], "hub": best[at]})


def _possible(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, least share of shingles apart) of the pairs in different components that their parities do not exclude."""
    _, fp, n, first, same = _columns(table)
    root = table.column("root").to_numpy()
    parity = table.column("parity").to_pylist()
    for i, j, _ in near_pairs(fp, n, first, same):
        other = root[i] != root[j]
        i, j = i[other], j[other]
        if len(i):
            apart = least_differences(parity, i, j)
            # Jaccard >= 4/5 is the same as at most a ninth of both sizes in one set only.
            held = 9 * apart <= n[i] + n[j]
            yield i[held], j[held], apart[held] / (n[i] + n[j])[held]


def _next_candidates(allotment: int):
    """For every open row the nearest ``allotment`` ones in other components beyond (after, after_hub), the least of equals first."""

    def nearest(row: np.ndarray, other: np.ndarray, apart: np.ndarray, rid: np.ndarray) -> np.ndarray:
        order = np.lexsort((rid[other], apart, row))
        first = np.searchsorted(row[order], row[order])
        return order[np.arange(len(order)) - first < allotment]

    def run(table: pa.Table) -> pa.Table:
        rid = table.column("rid").to_numpy()
        open_, after, after_hub = (table.column(c).to_numpy(zero_copy_only=False) for c in ("open", "after", "after_hub"))
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for i, j, apart in _possible(table):
            row, other, apart = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart])
            beyond = open_[row] & ((apart > after[row]) | ((apart == after[row]) & (rid[other] > after_hub[row])))
            held = tuple(np.concatenate(x) for x in zip(held, (row[beyond], other[beyond], apart[beyond])))
            if len(held[0]) > HELD_PAIRS:
                kept = nearest(*held, rid)
                held = tuple(x[kept] for x in held)
        kept = nearest(*held, rid)
        row, other, apart = (x[kept] for x in held)
        return pa.table({"rid": rid[row], "apart": apart, "hub": rid[other]})

    return run


def _texts_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, text) for the rows (rid, id, hash); most other texts are left where they are by a filter of fixed size."""
    spark = docs.sparkSession
    bit = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    # At most 2^FILTER_BITS / 64 rows.
    words = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, dtype=np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column("hash").to_numpy().view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
            held = shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(held.astype(bool)))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").alias("own"), F.xxhash64(text).alias("hash"), text.alias("text"))
    held = named.mapInArrow(run, named.schema)
    joined = held.join(wanted, (held["hash"] == wanted["hash"]) & F.col("own").eqNullSafe(F.col("id")))
    return joined.select("rid", "text").dropDuplicates(["rid"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (src, dst) whose sets have a Jaccard similarity of 4/5 or more."""
    ends = [texts.select(F.col("rid").alias(c), F.col("text").alias(f"{c}_text")) for c in ("src", "dst")]
    both = pairs.join(ends[0], "src").join(ends[1], "dst")

    def run(a: pa.Array, b: pa.Array) -> list[pa.Array]:
        (x, x_at), (y, y_at) = shingle_sets(a), shingle_sets(b)
        shared = [len(np.intersect1d(x[s:e], y[t:u], assume_unique=True)) for s, e, t, u in zip(x_at, x_at[1:], y_at, y_at[1:])]
        return [pa.array(9 * np.array(shared, dtype=np.int64) >= 4 * (np.diff(x_at) + np.diff(y_at)))]

    checked = map_columns(both, run, [T.StructField("linked", T.BooleanType())], ["src_text", "dst_text"], ["src", "dst"])
    return materialise(checked.where("linked").select("src", "dst").distinct(), "verified")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, component_id) of every row; ``hash`` is the text's."""
    ship_package(docs.sparkSession)
    marked = materialise(_marked(docs, id_col, text_col), "shingles")
    # One row stands for each set.
    each = marked.groupBy("key").agg(F.min("id").alias("low"), F.min(F.struct("hash", "id")).alias("r"), *[F.min(c).alias(c) for c in ("n", "fp", "parity")])
    nodes = materialise(each.select("key", "low", "r.hash", "r.id", "n", "fp", "parity").withColumn("rid", F.monotonically_increasing_id()), "nodes")
    tiles = _tiles(nodes, ["rid", "n", "fp"])
    found = tiles.groupBy("a", "b").applyInArrow(_one_candidate, "rid long, hub long")
    active = materialise(found.groupBy("rid").agg(F.min("hub").alias("hub")).withColumn("hub", F.when(F.col("hub") < 2**63 - 1, F.col("hub") % (1 << 62))), "active")
    held = nodes.join(active.select("rid"), "rid")
    texts = materialise(_texts_of(docs, held.select("rid", "id", "hash"), id_col, text_col), "candidates")
    links = _verified(active.where("hub IS NOT NULL").select(F.col("rid").alias("src"), F.col("hub").alias("dst")), texts)
    cursor = held.select("rid", F.lit(True).alias("open"), F.lit(-1.0).alias("after"), F.lit(-1).cast("long").alias("after_hub"))
    for allotment in itertools.chain(ALLOTMENTS, (ALLOTMENTS[-1] * 8**k for k in itertools.count(1))):
        roots = connected_components(links).withColumnRenamed("node", "rid")
        rooted = held.join(cursor, "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("component", "rid"))
        rooted = rooted.withColumns({"open": F.coalesce("open", F.lit(False)), "after": F.coalesce("after", F.lit(0.0)), "after_hub": F.coalesce("after_hub", F.lit(0))})
        tiles = _tiles(rooted, ["rid", "n", "fp", "parity", "root", "open", "after", "after_hub"]).groupBy("a", "b")
        found = tiles.applyInArrow(_next_candidates(allotment), "rid long, apart double, hub long")
        place = F.row_number().over(Window.partitionBy("rid").orderBy("apart", "hub"))  # an allotment a tile pair
        sent = materialise(found.withColumn("place", place).where(F.col("place") <= allotment), "pairs")
        if not sent.limit(1).count():
            break
        pairs = sent.select(F.least("rid", "hub").alias("src"), F.greatest("rid", "hub").alias("dst")).distinct()
        links = links.unionByName(_verified(pairs, texts))
        # A text that used its whole allotment may have more.
        last = sent.groupBy("rid").agg(F.max(F.struct("apart", "hub")).alias("last"), F.count("*").alias("n")).where(F.col("n") == allotment)
        cursor = materialise(last.select("rid", F.lit(True).alias("open"), F.col("last.apart").alias("after"), F.col("last.hub").alias("after_hub")), "cursor")
    joined = connected_components(links).withColumnRenamed("node", "rid")
    discard(texts)
    grouped = nodes.join(joined, "rid", "left").select("key", "low", F.coalesce("component", "rid").alias("root"))
    lows = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = materialise(grouped.join(lows, "root").select("key", "component_id"), "components")
    return marked.select("id", "hash", "key").join(placed, "key").select(F.col("id").alias(id_col), "hash", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, all columns unchanged.

    Of repeated rows of one id one stays; rows without an id stay where no row of their component has one,
    exact copies among them once.
    """
    key, digest, times, row = (fresh(docs, c) for c in ("kept", "kept_hash", "kept_times", "kept_row"))
    of_text = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    own = F.col(f"`{id_col}`")
    found = near_duplicate_components(docs, id_col, text_col).where(own.eqNullSafe(F.col("component_id")))
    # Of several texts of one id, the one with the least hash.
    held = found.groupBy(own.alias(key), F.when(own.isNull(), F.col("hash")).alias("each")).agg(F.min("hash").alias(digest), F.count("*").alias(times))
    kept = materialise(held.drop("each"), "kept")
    joined = docs.join(kept, own.eqNullSafe(F.col(key)) & (of_text == F.col(digest)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = Window.partitionBy(F.col(key), F.col(digest)).orderBy(F.col(digest))
    repeated = joined.where(F.col(times) > 1).withColumn(row, F.row_number().over(one)).where(F.col(row) == 1)
    return joined.where(F.col(times) == 1).select(*columns).unionByName(repeated.select(*columns))
