"""Phrase collocations: an FM-index over word ids per shard, counts summed across shards.

A task cuts its texts into shards of one language and at most about SHARD_WORDS words. A shard is a word array with a
break (0) between pieces; it keeps the Burrows-Wheeler transforms of the array and of its reverse, of rotations sorted
by their first eight symbols, which is all that phrases of five words ask of them. A phrase is an interval in
both; extending it to the left reads the forward transform, to the right the reverse one, and moves both intervals
along. All phrases of one length are extended at once, two-word ones to the left, three-word ones to the right, and so on.

Lengths grow in rounds. In a round every shard hashes its phrases that are one word longer into cells and sends the cells'
counts, packed by ranges of cells; a task a range sums them over all shards and tells each shard which of its cells hold
``least`` occurrences or more. A cell's sum is no less than any of its phrases' counts, so a phrase in another cell is not
frequent, and a longer phrase is tried only where both its shorter ends lie in such cells. At the end the shards send the
phrases left, as text with their counts and packed in the same way, and exact sums decide. So only packed cells and the few phrases left are
shuffled; the index is written once, bucketed by shard, and every round reads it where it lies. There are two to
four times as many cells as words, and a range for every RANGE_WORDS of them, whatever their number.

Defined cases: a null text is empty; a null language is ``und``; an empty table gives an empty result; repeated rows
count again; of texts of any length the pieces are read in blocks; columns beyond text and language are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import delete_folder, materialise, ship_package, slices, work_path

#: Words of a shard, about; a task holds no more at once. Words of a phrase, at most.
SHARD_WORDS, LONGEST = 1 << 20, 5
#: Words for which there is one range of cells, and ranges at least.
RANGE_WORDS, LEAST_RANGES = 1 << 21, 64
#: Bytes of text whose words are listed at once.
BLOCK_BYTES = 8 << 20
#: Candidates that one task ranks, about.
RANKED_ROWS = 500_000

_PLAIN = bytes(range(256))
#: A-Z to lower case, every piece end to a line feed, tabs to spaces.
_FOLD = _PLAIN.lower().translate(bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n "))


def blocks(raw: bytes, limit: int = BLOCK_BYTES) -> Iterator[bytes]:
    """``raw`` folded, in parts of about ``limit`` bytes that end where a piece ends."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = len(folded)
        if end - at > limit:
            cut = folded.rfind(b"\n", at, at + limit)
            end = (cut if cut >= 0 else folded.find(b"\n", at)) + 1 or end
        yield folded[at:end]
        at = end


def symbols(block: bytes, vocabulary: defaultdict) -> np.ndarray:
    """Word numbers from 1 of a folded block, with a 0 where pieces with words meet and at the end."""
    words = block.split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    ids = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words)) + 1
    code = np.frombuffer(block, dtype=np.uint8)
    ends = code == 10
    inside = ~(ends | (code == 32))
    inside[1:] &= ~inside[:-1]
    piece = np.cumsum(ends, dtype=np.int32)[np.flatnonzero(inside)]
    new = np.zeros(len(words), dtype=np.int64)
    new[1:] = piece[1:] != piece[:-1]
    out = np.zeros(len(words) + int(new.sum()) + 1, dtype=np.int32)
    out[np.arange(len(words)) + np.cumsum(new)] = ids
    return out


def transform(text: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """Burrows-Wheeler transform of the cyclic rotations, sorted by their first ``depth`` symbols at least."""
    rank, sorted_by = text.astype(np.int64), 1
    while sorted_by < depth or sorted_by == 1:
        key = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -sorted_by)
        order = np.argsort(key)  # rotations that agree so far may come in any order
        key = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        sorted_by *= 2
    return text[order - 1]


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0 to 2^31, by their lower and their upper half, which numpy sorts by counting."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((x >> 16).astype(np.uint16)[low], kind="stable")]


def starts_of(transformed: np.ndarray, size: int) -> np.ndarray:
    """Rows that sort before those of each symbol 0..size-1."""
    counts = np.bincount(transformed, minlength=size)
    return np.cumsum(counts) - counts


def _spans(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers begins[0]..ends[0]-1, begins[1]..ends[1]-1 and so on."""
    n = ends - begins
    return np.arange(int(n.sum())) + np.repeat(begins - (np.cumsum(n) - n), n)


#: Factor of the rolling hash of words.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@dataclass
class Phrases:
    """Phrases of one length in a shard: first rows of their intervals in both transforms, rows, word numbers, hash, and the
    places of their first and last words but one in the phrases one word shorter."""

    forward: np.ndarray
    reverse: np.ndarray
    n: np.ndarray
    words: np.ndarray
    hash: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    def take(self, at: np.ndarray) -> Phrases:
        return Phrases(*(getattr(self, f)[at] for f in ("forward", "reverse", "n", "words", "hash", "head", "tail")))


@dataclass
class Shard:
    """An unpacked row of the index."""

    starts: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray
    forward: np.ndarray
    reverse: np.ndarray
    seed: np.uint64
    orders: dict[bool, np.ndarray] = field(default_factory=dict)

    def single(self) -> Phrases:
        zero = np.zeros(len(self.counts), dtype=np.int64)
        return Phrases(self.starts, self.starts, self.counts, np.arange(1, len(zero) + 1)[:, None], self.hashes, zero, zero)

    def order(self, left: bool) -> np.ndarray:
        """The rows of a transform by their symbol: the k-th leads to row k, that of its rotation by one."""
        if left not in self.orders:
            self.orders[left] = stable_order(self.forward if left else self.reverse)
        return self.orders[left]

    def extend(self, p: Phrases, left: bool, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Phrases:
        """All phrases one word longer whose first and last words but one are among ``p``; only those whose hash is ``wanted``."""
        transformed = self.forward if left else self.reverse
        near, far, but_near, but_far = (p.forward, p.reverse, p.tail, p.head) if left else (p.reverse, p.forward, p.head, p.tail)
        edge = p.words[:, 0 if left else -1]
        # Rows of all intervals by symbol, then by row: a phrase's rows with one symbol stand together.
        owner_of = np.full(len(transformed), -1, dtype=np.int32)
        owner_of[_spans(near, near + p.n)] = np.repeat(np.arange(len(p.n), dtype=np.int32), p.n)
        order = self.order(left)
        owner = owner_of[order]
        moved = np.flatnonzero(owner >= 0)
        owner, symbol = owner[moved], transformed[order[moved]]
        new = np.ones(len(moved), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(moved)))
        owner, word, moved = owner[first].astype(np.int64), symbol[first].astype(np.int64), moved[first]
        words = np.flatnonzero(word > 0)
        single = p.words.shape[1] == 1
        hashed = self.hashes[word[words] - 1] * _BASE ** np.uint64(p.words.shape[1]) + p.hash[owner[words]] if left else p.hash[owner[words]] * _BASE + self.hashes[word[words] - 1]
        held = np.arange(len(words)) if wanted is None else np.flatnonzero(wanted(hashed))
        if single:
            other = word[words[held]] - 1
        else:  # the other end: the new word, then the phrase without its far word
            width = np.int64(len(self.counts) + 1)
            ends = but_near * width + edge
            by_end = np.argsort(ends)
            key = but_far[owner[words[held]]] * width + word[words[held]]
            at = by_end[np.minimum(np.searchsorted(ends[by_end], key), len(ends) - 1)] if len(ends) else key
            there = ends[at] == key if len(ends) else np.zeros(0, dtype=bool)
            held, other = held[there], at[there]
        # Rows of the phrase before which a smaller symbol stands, breaks included.
        by_owner = stable_order(owner)
        running = np.cumsum(count[by_owner]) - count[by_owner]
        leads = np.flatnonzero(np.concatenate([[True], owner[by_owner][1:] != owner[by_owner][:-1]])) if len(owner) else by_owner
        below = np.empty(len(owner), dtype=np.int64)
        below[by_owner] = running - np.repeat(running[leads], np.diff(np.append(leads, len(owner))))
        at = words[held]
        owner, word, moved, count, along, hashed = owner[at], word[at], moved[at], count[at], far[owner[at]] + below[at], hashed[held]
        if left:
            return Phrases(moved, along, count, np.column_stack([word, p.words[owner]]), hashed, other, owner)
        return Phrases(along, moved, count, np.column_stack([p.words[owner], word]), hashed, owner, other)

    def cells(self, hashes: np.ndarray, bits: int) -> np.ndarray:
        return _mix(hashes + self.seed) >> np.uint64(64 - bits)

    def grow(self, held: dict[int, np.ndarray], bits: int) -> Iterator[Phrases]:
        """Phrases of 2, 3, ... words in the cells ``held`` by length, and then those one word longer in any cell."""
        p = self.single()
        for size in range(2, len(held) + 3):
            p = self.extend(p, size % 2 == 0, (lambda h: _among(self.cells(h, bits), held[size])) if size in held else None)
            yield p


def _among(cells: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of ``cells`` are in ``held``; most of the others are told by their last bits."""
    low = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, dtype=bool)
    maybe[held & low] = True
    out = maybe[cells & low]
    out[out] = np.isin(cells[out], held)
    return out


def unpacked(row: dict) -> Shard:
    forward, reverse = (unpacked_numbers(row[c]).view(np.int32) for c in ("forward", "reverse"))
    counts = np.array(row["counts"], dtype=np.int64)
    starts = len(forward) - counts.sum() + np.cumsum(counts) - counts  # breaks sort first
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in row["words"]], dtype=np.uint64)
    return Shard(starts, counts, hashes, forward, reverse, np.uint64(xxhash.xxh64_intdigest(row["lang"].encode())))


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2^32 by planes of bytes, of which the higher ones are mostly zero."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked_numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def packed_cells(cells: np.ndarray, n: np.ndarray, bits: int, range_bits: int) -> Iterator[tuple[int, bytes]]:
    """(range, distinct cells of the range and their counts, packed); a range is a cell's first ``range_bits`` of ``bits``."""
    order = np.argsort(cells)
    cells, n = cells[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else order
    n = np.minimum(np.add.reduceat(n, first), (1 << 32) - 1) if len(first) else n
    cells = cells[first]
    shift = np.uint64(bits - range_bits)
    place = (cells & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    cut = np.searchsorted(cells, np.arange((1 << range_bits) + 1, dtype=np.uint64) << shift)
    for r, (s, e) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
        if e > s:
            yield r, packed(np.concatenate([np.diff(place[s:e], prepend=0), n[s:e]]))


def _cells_of(steps: np.ndarray, of: int, bits: int, range_bits: int) -> np.ndarray:
    """Cells from their steps inside a range."""
    return np.cumsum(steps, dtype=np.uint64) + (np.uint64(of) << np.uint64(bits - range_bits))


def unpacked_cells(raw: bytes, of: int, bits: int, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = unpacked_numbers(raw)
    return _cells_of(both[: len(both) // 2], of, bits, range_bits), both[len(both) // 2 :].astype(np.int64)


class _Shards:
    """The words of a task by language, given away as indexed shards."""

    def __init__(self, task: int, limit: int):
        self.next, self.limit = task << 32, limit
        self.parts: dict[str, list[np.ndarray]] = {}
        self.words: dict[str, defaultdict] = {}
        self.held: dict[str, int] = {}

    def add(self, lang: str, raw: bytes) -> Iterator[pa.RecordBatch]:
        for block in blocks(raw):
            if lang not in self.words:
                vocabulary: defaultdict = defaultdict()
                vocabulary.default_factory = vocabulary.__len__
                self.words[lang], self.parts[lang], self.held[lang] = vocabulary, [], 0
            part = symbols(block, self.words[lang])
            self.parts[lang].append(part)
            self.held[lang] += len(part)
            if sum(self.held.values()) > self.limit:
                yield self.give(max(self.held, key=self.held.get))

    def give(self, lang: str) -> pa.RecordBatch:
        text, words = np.concatenate([*self.parts.pop(lang), np.zeros(1, dtype=np.int32)]), list(self.words.pop(lang))
        self.held.pop(lang)
        forward, reverse = (packed(transform(t)) for t in (text, text[::-1]))
        counts = np.bincount(text, minlength=len(words) + 1)
        self.next += 1
        lists = (pa.array([x], pa.list_(kind)) for x, kind in ((words, pa.binary()), (counts[1:], pa.int64())))
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([self.next], pa.int64()), *lists, pa.array([forward], pa.binary()), pa.array([reverse], pa.binary())],
            names=["lang", "shard", "words", "counts", "forward", "reverse"],
        )


def build_index(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a shard: (lang, shard, words, counts, forward, reverse)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(TaskContext.get().partitionId(), shard_words)
        for batch in slices(batches):
            langs = batch.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, i)).to_pylist()
                yield from shards.add(lang, b"\n".join(texts))
        for lang in list(shards.held):
            yield shards.give(lang)

    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary"))
    named = docs.select(text.alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"))
    schema = "lang string, shard long, words array<binary>, counts array<long>, forward binary, reverse binary"
    return named.mapInArrow(run, schema)


def _cells_held(rows: pa.Table, bits: int, range_bits: int) -> dict[int, np.ndarray]:
    out: dict[int, list[np.ndarray]] = {}
    for size, of, steps in zip(*(rows.column(c).to_pylist() for c in ("size", "range", "held"))):
        out.setdefault(size, []).append(_cells_of(unpacked_numbers(steps), of, bits, range_bits))
    return {size: np.concatenate(parts) for size, parts in sorted(out.items())}


def _sent_cells(index: DataFrame, held: DataFrame, size: int, bits: int, range_bits: int) -> DataFrame:
    """(range, shard, cells) of the phrases of ``size`` words whose shorter ends are held."""

    def run(shard: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for row in shard.to_pylist():
            known = _cells_held(rows, bits, range_bits)
            if len(known) == size - 2:  # else it has no frequent phrase of some shorter length
                opened = unpacked(row)
                p = list(opened.grow(known, bits))[-1]
                out += [(r, row["shard"], c) for r, c in packed_cells(opened.cells(p.hash, bits), p.n, bits, range_bits)]
        return pa.table({name: pa.array([x[i] for x in out], kind) for i, (name, kind) in enumerate((("range", pa.int64()), ("shard", pa.int64()), ("cells", pa.binary())))})

    return index.groupBy("shard").cogroup(held.groupBy("of")).applyInArrow(run, "range long, shard long, cells binary")


def _kept_cells(sent: DataFrame, size: int, bits: int, range_bits: int, least: int) -> DataFrame:
    """(of, size, range, held): each shard's cells with a sum of at least ``least``."""

    def run(table: pa.Table) -> pa.Table:
        of = table.column("range")[0].as_py()
        parts = [unpacked_cells(c, of, bits, range_bits) for c in table.column("cells").to_pylist()]
        distinct, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        frequent = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(distinct))[at] >= least
        first, out = np.uint64(of) << np.uint64(bits - range_bits), []
        for shard, (cells, _), own in zip(table.column("shard").to_pylist(), parts, np.split(frequent, np.cumsum([len(c) for c, _ in parts])[:-1])):
            if own.any():
                out.append((shard, packed(np.diff((cells[own] - first).astype(np.int64), prepend=0))))
        ids = {"of": pa.array([s for s, _ in out], pa.int64()), "size": pa.array([size] * len(out), pa.int32()), "range": pa.array([of] * len(out), pa.int64())}
        return pa.table(ids | {"held": pa.array([h for _, h in out], pa.binary())})

    return sent.groupBy("range").applyInArrow(run, "of long, size int, range long, held binary")


def packed_phrases(size: list[int], phrase: list[bytes], count: list[int]) -> bytes:
    """Phrases in their order, which compresses their common beginnings, with sizes and counts."""
    order = sorted(range(len(phrase)), key=phrase.__getitem__)
    numbers = packed(np.array([[size[i] for i in order], [min(count[i], (1 << 32) - 1) for i in order]]).ravel())
    return len(numbers).to_bytes(8, "little") + numbers + zstandard.ZstdCompressor(level=9).compress(b"\n".join([phrase[i] for i in order]))


def unpacked_phrases(raw: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    cut = 8 + int.from_bytes(raw[:8], "little")
    numbers = unpacked_numbers(raw[8:cut])
    return numbers[: len(numbers) // 2], zstandard.ZstdDecompressor().decompress(raw[cut:]).split(b"\n"), numbers[len(numbers) // 2 :].astype(np.int64)


def _sent_phrases(index: DataFrame, held: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """(range, lang, rows): the phrases that a shard holds in the cells left with their counts, packed by ranges of their cells."""

    def run(shard: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        for row in shard.to_pylist():
            known, words = _cells_held(rows, bits, range_bits), row["words"]
            known = {s: known[s] for s in range(2, max(known, default=1) + 1) if all(t in known for t in range(2, s + 1))}
            ranges, size, phrase, count = [np.zeros(0, dtype=np.int64)], [], [], []
            opened = unpacked(row)
            for m, p in zip(known, opened.grow(known, bits)):
                ranges.append((opened.cells(p.hash, bits) >> np.uint64(bits - range_bits)).astype(np.int64))
                phrase += [b" ".join([words[i] for i in w]) for w in (p.words - 1).tolist()]
                count += p.n.tolist()
                size += [m] * len(p.n)
            ranges = np.concatenate(ranges)
            order = np.argsort(ranges, kind="stable")
            cut = np.searchsorted(ranges[order], np.arange((1 << range_bits) + 1)).tolist()
            for r, (s, e) in enumerate(zip(cut, cut[1:])):
                if e > s:
                    at = order[s:e].tolist()
                    out.append((r, row["lang"], packed_phrases(*([x[i] for i in at] for x in (size, phrase, count)))))
        return pa.table({"range": pa.array([x[0] for x in out], pa.int64()), "lang": pa.array([x[1] for x in out], pa.string()), "rows": pa.array([x[2] for x in out], pa.binary())})

    return index.groupBy("shard").cogroup(held.groupBy("of")).applyInArrow(run, "range long, lang string, rows binary")


def _summed_phrases(sent: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, a) of the phrases with at least ``least`` occurrences in all shards."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for lang, raw in zip(table.column("lang").to_pylist(), table.column("rows").to_pylist()):
            size, phrase, n = unpacked_phrases(raw)
            parts.append(pa.table({"lang": pa.array([lang] * len(phrase)), "size": pa.array(size.astype(np.int32)), "phrase": pa.array(phrase, pa.binary()), "n": n}))
        summed = pa.concat_tables(parts).group_by(["lang", "size", "phrase"]).aggregate([("n", "sum")])
        return summed.filter(pc.greater_equal(summed.column("n_sum"), least)).select(["lang", "size", "phrase", "n_sum"]).rename_columns(["lang", "size", "phrase", "a"])

    return sent.groupBy("range").applyInArrow(run, "lang string, size int, phrase binary, a long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, a) of all phrases of 1 to ``longest`` words with at least ``least`` occurrences, (lang, n) words)."""
    spark = docs.sparkSession
    ship_package(spark)
    name, path = f"fm_index_{uuid.uuid4().hex}", work_path(spark, "fm-index")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    build_index(docs, text_col, lang_col, shard_words).write.bucketBy(buckets, "shard").option("path", path).saveAsTable(name)
    index = spark.table(name)
    words = index.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.*")
    totals = materialise(index.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n")), "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(20, math.ceil(math.log2(n + 1)) + 1)
    range_bits = math.ceil(math.log2(max(LEAST_RANGES, n / RANGE_WORDS)))
    held = spark.createDataFrame([], "of long, size int, range long, held binary")
    for size in range(2, longest + 1):
        sent = materialise(_sent_cells(index, held, size, bits, range_bits), "cells")
        held = held.unionByName(materialise(_kept_cells(sent, size, bits, range_bits, least), "held"))
    exact = _summed_phrases(_sent_phrases(index, held, bits, range_bits), least)
    single = words.groupBy("lang", F.lit(1).alias("size"), F.col("words").alias("phrase")).agg(F.sum("counts").alias("a"))
    found = single.unionByName(exact).where(F.col("a") >= least).withColumn("phrase", F.col("phrase").cast("string"))
    found = materialise(found, "phrases")
    spark.sql(f"DROP TABLE {name}")
    delete_folder(spark, path)
    return found, totals


def extensions(found: DataFrame) -> DataFrame:
    """(lang, phrase, left_most, right_most): highest count of a frequent phrase one word longer to the left and to the right."""
    longer = found.where("size > 1")
    cut = lambda c, pattern: F.regexp_replace(c, pattern, "")
    tail = longer.select("lang", cut(F.col("phrase"), "^[^ ]* ").alias("phrase"), F.col("a").alias("left"), F.lit(None).cast("long").alias("right"))
    head = longer.select("lang", cut(F.col("phrase"), " [^ ]*$").alias("phrase"), F.lit(None).cast("long").alias("left"), F.col("a").alias("right"))
    return tail.unionByName(head).groupBy("lang", "phrase").agg(F.max("left").alias("left_most"), F.max("right").alias("right_most"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most: int = 2000, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, k) of each language's ``most`` best phrases.

    The score of a phrase is that of its worst cut into two parts, floor(1000 a n / (l r)). A phrase that occurs only inside
    a longer frequent one is left out; looking one word to each side is enough, as counts do not grow with length.
    """
    found, totals = frequent_phrases(docs, text_col, lang_col, least, longest, shard_words)
    alone = (
        found.where("size > 1").join(extensions(found), ["lang", "phrase"], "left")
        .where(~F.coalesce(F.greatest("left_most", "right_most") >= F.col("a"), F.lit(False)))
    )
    w = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(w, start, size), " ")
    cuts = alone.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")
    )
    both = (
        cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
        .join(found.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    )
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * whole("a")).cast("decimal(19,0)") * whole("n")
    cut = F.struct(F.call_function("div", above, whole("l") * whole("r")).alias("score"), "k", "l", "r")
    scored = materialise(both.groupBy("lang", "phrase", "a", "n").agg(F.min(cut).alias("cut")).select("lang", "phrase", "a", "n", "cut.*"), "scored")
    # A language may hold most phrases: its best are first taken from parts of bounded size.
    parts = -(-scored.count() // RANKED_ROWS)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = F.pmod(F.xxhash64("phrase"), F.lit(max(parts, 1)))
    few = scored.withColumn("part", dealt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))
