"""Language-model scores by context-tree weighting over bytes.

Every byte is coded as eight binary decisions. Each node of the context tree, a string of preceding bytes, keeps for
every partial byte the counts of zeros and ones and their Krichevsky-Trofimov estimate; weighting mixes the estimates
of all depths bottom up, P_w = 1/2 KT + 1/2 product of the children's P_w, and a prediction mixes KT over the
nodes of its context with the weights that the training counts leave at each depth. Every context that occurs in the
training texts is a node; none is dropped or merged, so the tree grows with the corpus.

All counts are rows in Spark: the distinct (depth + 1)-byte strings of all texts with their training counts, summed in
one shuffle. As numbers, with the nearest byte highest, the strings under one context are an interval. Contexts with
more than SUBTREE strings are split into their children, and neighbouring children below that bound go together, so
the strings fall into intervals of bounded size, each of which a task handles whole: first it sends its weighted
probabilities to the contexts above, at most 255 rows an interval; the driver weights the split contexts, of which
there are at most depth times the number of strings over SUBTREE; then each task mixes downwards from them
and gives every string its log probability.

Texts are scored where they are read. The probabilities of the most frequent strings, HEAVY_STRINGS at most, and the
counts of the most frequent words, HEAVY_WORDS at most and none longer than WORD_BYTES, are broadcast; every other string or
word of a text is joined in a shuffle. The base score is a unigram model over words.

A text's code is its bytes and one end symbol, the byte 255, which UTF-8 does not use; the symbols before the first
byte count as 255. Defined cases: a null or empty text is the end symbol alone; without any training text all
predictions are uniform, train_tokens is 0 and the base score is 0; repeated rows are scored one by one; a row whose
training flag is null is not learned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandloom.llm.common import materialise, ship_package, slices

#: Bytes of context; a string of depth + 1 bytes must fit into 63 bits.
DEPTH = 5
#: Strings that a task weights together, at most; more than a context of full depth can have.
SUBTREE = 250_000
#: Strings and words that are broadcast, at most, and the longest of those words.
HEAVY_STRINGS, HEAVY_WORDS, WORD_BYTES = 1_000_000, 200_000, 64
END = 255
#: Distinct strings and words that a task combines before it sends them.
FLUSH = 750_000
#: Bytes of texts that a task codes at once; each takes some 70 bytes of work space.
CODED_BYTES = 1 << 20

_LGAMMA = np.array([math.lgamma(n / 2) for n in range(1, 1 << 13)])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function of halves of positive whole numbers; Stirling's series above the table."""
    twice = np.rint(2 * np.asarray(x, dtype=np.float64)).astype(np.int64)
    out = _LGAMMA[np.minimum(twice, len(_LGAMMA)) - 1]
    large = np.flatnonzero(twice > len(_LGAMMA))
    if len(large):
        z = twice[large] / 2.0
        out[large] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def code(texts: pa.StringArray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings that end at each coded symbol, nearest context byte highest and the symbol lowest; symbols per text."""
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    pad = bytes([END])
    framed = pc.binary_join_element_wise(pa.scalar(pad * depth), texts.cast(pa.binary()), pa.scalar(pad), b"")
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(framed)], framed), b"")[0].as_buffer(), dtype=np.uint8)
    coded = lengths + 1
    where = np.arange(int(coded.sum())) + np.repeat(np.arange(1, len(coded) + 1) * depth, coded)
    value = np.zeros(len(data), dtype=np.int64)
    for back in range(1, depth + 1):
        value[depth:] = value[depth:] << 8 | data[depth - back : len(data) - back]
    return (value << 8 | data)[where], coded


def words_of(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, A-Z lower-cased, and the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
    held = pc.not_equal(flat, "")
    return flat.filter(held).dictionary_encode(), text[held.to_numpy(zero_copy_only=False)]


def _merged(held: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of two sets of distinct strings as one."""
    value, n = np.concatenate([held[0], more[0]]), np.concatenate([held[1], more[1]])
    order = np.argsort(value, kind="stable")
    value = value[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, dtype=np.int64)
    return value[first], np.add.reduceat(n[order], first) if len(first) else n


def _gather(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Training counts of the strings of all texts, and of the words of training texts, combined as far as FLUSH allows."""
    nothing = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    held, words, size = nothing, [], 0

    def summed() -> tuple[pa.Array, np.ndarray]:
        if not words:
            return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
        table = pa.table({"word": pa.concat_arrays([w for w, _ in words]), "n": np.concatenate([c for _, c in words])})
        table = table.group_by("word").aggregate([("n", "sum")])
        word = pa.concat_arrays(table["word"].chunks) if table["word"].num_chunks else pa.array([], pa.string())
        return word, table["n_sum"].to_numpy().astype(np.int64)

    def out() -> pa.RecordBatch:
        value, n = held
        word, count = summed()
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(value), pa.nulls(len(word), pa.int64())]), pa.concat_arrays([pa.nulls(len(value), pa.string()), word]),
             pa.concat_arrays([pa.array(n), pa.array(count)])],
            names=["string", "word", "n"],
        )

    for batch in slices(batches, CODED_BYTES):
        texts, train = batch.column("text").fill_null(""), batch.column("train").fill_null(False)
        strings, coded = code(texts, depth)
        distinct = pa.array(strings).dictionary_encode()
        number = distinct.indices.to_numpy(zero_copy_only=False)
        learned = np.repeat(train.to_numpy(zero_copy_only=False), coded)
        counts = np.bincount(number[learned], minlength=len(distinct.dictionary)).astype(np.int64)
        held = _merged(held, (distinct.dictionary.to_numpy(), counts))
        found, _ = words_of(texts.filter(train))
        words.append((found.dictionary, np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary))))
        size += len(found.dictionary)
        if len(held[0]) + size > FLUSH:
            words = [summed()]
            size = len(words[0][0])
        if len(held[0]) + size > FLUSH:
            yield out()
            held, words, size = nothing, [], 0
    yield out()


@dataclass
class Nodes:
    """Nodes (context, partial byte) of one depth and one decision, ascending; ``key`` is the context and the bits taken so far."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    block: np.ndarray
    weighted: np.ndarray
    mixed: np.ndarray | None = None
    left: np.ndarray | None = None

    @property
    def zero(self) -> np.ndarray:
        return (self.n0 + 0.5) / (self.n0 + self.n1 + 1)


def _block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 2 * math.lgamma(0.5) - log_gamma(n0 + n1 + 1)


def weigh(strings: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[list[Nodes]]:
    """Nodes of the depths ``top`` to ``depth`` and the eight decisions, weighted bottom up; from counted strings, ascending."""
    out: list[list[Nodes]] = []
    for d in range(depth, top - 1, -1):
        if d < depth:  # drop the oldest byte of the context
            shorter = strings >> 8 * (depth - d + 1) << 8 | strings & 255
            keys, n = _merged((shorter, counts), (shorter[:0], counts[:0]))
        else:
            keys, n = strings, counts
        level = []
        for b in range(8):
            path = keys >> 8 - b
            first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, dtype=np.int64)
            both = np.add.reduceat(n, first) if len(first) else n[:0]
            ones = np.add.reduceat(np.where(keys >> 7 - b & 1 == 1, n, 0), first) if len(first) else n[:0]
            node = path[first]
            block = _block(both - ones, ones)
            if d == depth:
                weighted = block
            else:
                below = out[-1][b]
                parent = np.searchsorted(node, below.key >> 8 + b << b | below.key & (1 << b) - 1)
                split = np.bincount(parent, weights=below.weighted, minlength=len(node))
                weighted = np.logaddexp(block, split) - math.log(2)
            level.append(Nodes(node, both - ones, ones, block, weighted))
        out.append(level)
    return out[::-1]


def _stay(block: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate."""
    return np.exp(block - math.log(2) - weighted)


def upward(strings: np.ndarray, counts: np.ndarray, depth: int, parent: int) -> pa.Table:
    """What an interval of strings below contexts of depth ``parent`` adds to their context: counts and log P_w a node."""
    top = weigh(strings, counts, depth, parent + 1)[0]
    nodes, n0, n1, weighted = [], [], [], []
    for b, level in enumerate(top):
        key, at = np.unique(1 << b | level.key & (1 << b) - 1, return_inverse=True)
        nodes.append(key)
        n0.append(np.bincount(at, weights=level.n0, minlength=len(key)))
        n1.append(np.bincount(at, weights=level.n1, minlength=len(key)))
        weighted.append(np.bincount(at, weights=level.weighted, minlength=len(key)))
    return pa.table({"node": np.concatenate(nodes).astype(np.int32), "n0": np.concatenate(n0), "n1": np.concatenate(n1), "weighted": np.concatenate(weighted)})


def downward(strings: np.ndarray, counts: np.ndarray, depth: int, parent: int, mixed: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 probability of every string's last byte after its context; ``mixed`` and ``left`` are those of the context above, by node.

    Strings without a count, which only texts that are not learned have, end each decision at the deepest node that has one.
    """
    seen = counts > 0
    levels = weigh(strings[seen], counts[seen], depth, parent + 1)
    for d, level in enumerate(levels, parent + 1):
        for b, nodes in enumerate(level):
            path = nodes.key & (1 << b) - 1
            if d == parent + 1:
                m, w = mixed[1 << b | path], left[1 << b | path]
            else:
                above = levels[d - parent - 2][b]
                at = np.searchsorted(above.key, nodes.key >> 8 + b << b | path)
                m, w = above.mixed[at], above.left[at]
            stay = _stay(nodes.block, nodes.weighted) if d < depth else np.ones(len(nodes.key))
            nodes.mixed, nodes.left = m + w * stay * nodes.zero, w * (1 - stay)
    out = np.zeros(len(strings))
    byte = strings & 255
    for b in range(8):
        zero = np.empty(len(strings))
        open_ = np.arange(len(strings))
        path = byte >> 8 - b
        for d in range(depth, parent, -1):
            nodes = levels[d - parent - 1][b]
            wanted = strings[open_] >> 8 * (depth - d + 1) << b | path[open_]
            at = np.searchsorted(nodes.key, wanted)
            found = np.flatnonzero(np.append(nodes.key, -1)[at] == wanted)
            hit = at[found]
            zero[open_[found]] = nodes.mixed[hit] + nodes.left[hit] / 2
            open_ = np.delete(open_, found)
        at = 1 << b | path[open_]
        zero[open_] = mixed[at] + left[at] / 2
        out += np.log10(np.where(byte >> 7 - b & 1 == 1, 1 - zero, zero))
    return out


@dataclass
class Intervals:
    """Intervals of strings: where each starts, and depth and number of the split context that it lies below."""

    starts: np.ndarray
    depth: list[int]
    context: list[int]


def intervals(counts: DataFrame, depth: int, limit: int) -> Intervals:
    """Intervals of at most ``limit`` distinct strings, from rows (string, n); one aggregation a depth, over split contexts only."""
    found = []  # (first string, depth above, context above)
    split = {0}
    for d in range(1, depth + 1):
        above = F.shiftrightunsigned("string", 8 * (depth - d + 2))
        within = counts if d == 1 else counts.where(above.isin(sorted(split)))
        # At most 256 rows a split context.
        sizes = sorted(tuple(r) for r in within.groupBy(F.shiftrightunsigned("string", 8 * (depth - d + 1)).alias("context")).count().collect())
        full, last, room, deeper = 8 * (depth - d + 1), None, 0, set()
        for context, n in sizes:
            if n > limit and d < depth:
                deeper.add(context)
                last = None
            elif last == context >> 8 and n <= room:
                room -= n
            else:
                found.append((context << full, d - 1, context >> 8))
                last, room = context >> 8, limit - n
        split = deeper
        if not split:
            break
    found.sort()
    return Intervals(np.array([f[0] for f in found], dtype=np.int64), [f[1] for f in found], [f[2] for f in found])


def upper_tree(cut: Intervals, rows: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(depth, context) of every split context -> its mixture and the weight left, by node; from the rows of ``upward``."""
    contexts = {(0, 0)} | {(d - i, c >> 8 * i) for d, c in zip(cut.depth, cut.context) for i in range(d + 1)}
    sums = {key: np.zeros((3, 256)) for key in contexts}
    columns = [rows.column(c).to_numpy() for c in ("interval", "node", "n0", "n1", "weighted")]
    for i, node, *values in zip(*(c.tolist() for c in columns)):
        sums[cut.depth[i], cut.context[i]][:, node] += values
    stays = {}
    for d, c in sorted(contexts, reverse=True):
        n0, n1, split = sums[d, c]
        block = _block(n0, n1)
        weighted = np.logaddexp(block, split) - math.log(2)
        stays[d, c] = (_stay(block, weighted), (n0 + 0.5) / (n0 + n1 + 1))
        if d:
            sums[d - 1, c >> 8] += np.stack([n0, n1, weighted])
    out = {}
    for d, c in sorted(contexts):
        mixed, left = out[d - 1, c >> 8] if d else (np.zeros(256), np.ones(256))
        stay, zero = stays[d, c]
        out[d, c] = (mixed + left * stay * zero, left * (1 - stay))
    return out


def string_scores(counts: DataFrame, depth: int, limit: int) -> DataFrame:
    """(string, n, log10p) of every row (string, n)."""
    spark = counts.sparkSession
    cut = intervals(counts, depth, limit)
    starts = spark.sparkContext.broadcast(cut)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(starts.value.starts, batch.column("string").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column("string"), batch.column("n")], names=["interval", "string", "n"])

    def sorted_columns(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        string, n = (table.column(c).to_numpy() for c in ("string", "n"))
        order = np.argsort(string, kind="stable")
        return table.column("interval")[0].as_py(), string[order], n[order]

    def up(table: pa.Table) -> pa.Table:
        i, string, n = sorted_columns(table)
        found = upward(string, n, depth, starts.value.depth[i])
        return pa.table({"interval": np.full(len(found), i), **{c: found.column(c) for c in found.column_names}})

    numbered = counts.mapInArrow(number, "interval long, string long, n long")
    sums = numbered.where("n > 0").groupBy("interval").applyInArrow(up, "interval long, node int, n0 double, n1 double, weighted double").toArrow()
    upper = spark.sparkContext.broadcast(upper_tree(cut, sums))

    def down(table: pa.Table) -> pa.Table:
        i, string, n = sorted_columns(table)
        above = (starts.value.depth[i], starts.value.context[i])
        return pa.table({"string": string, "n": n, "log10p": downward(string, n, depth, above[0], *upper.value[above])})

    return materialise(numbered.groupBy("interval").applyInArrow(down, "string long, n long, log10p double"), "log10p")


def most_frequent(rows: DataFrame, limit: int) -> Column:
    """Condition on ``n`` that at most ``limit`` of the rows with the highest counts meet."""
    band = F.floor(F.log2(F.col("n").cast("double")) * 8)
    at_most, taken = None, 0
    # At most 8 rows a power of two.
    for r in sorted(rows.where("n > 0").groupBy(band.alias("band")).count().collect(), reverse=True):
        taken += r["count"]
        if taken > limit:
            break
        at_most = r.band
    return F.lit(False) if at_most is None else (F.col("n") > 0) & (band >= at_most)


def _rare(number: np.ndarray, text: np.ndarray, missing: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct entries without a broadcast value: their numbers and times text by text, and where each text's begin."""
    held = missing[number]
    pairs = text[held].astype(np.int64) * (len(missing) + 1) + number[held]
    distinct, times = np.unique(pairs, return_counts=True)
    begins = np.searchsorted(distinct, np.arange(n_texts + 1, dtype=np.int64) * (len(missing) + 1))
    return distinct % (len(missing) + 1), times, pa.array(begins, pa.int32())


def score_documents(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
    subtree: int = SUBTREE, heavy_strings: int = HEAVY_STRINGS, heavy_words: int = HEAVY_WORDS,
) -> DataFrame:
    """(id, row, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of ``docs``.

    ``training``, a condition on the columns of ``docs``, tells whose texts counts are learned from.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), training.alias("train"))
    gathered = materialise(
        texts.mapInArrow(lambda batches: _gather(batches, depth), "string long, word string, n long").groupBy("string", "word").agg(F.sum("n").alias("n")), "counts"
    )
    words = gathered.where("word IS NOT NULL").select("word", "n")
    strings = string_scores(gathered.where("string IS NOT NULL").select("string", "n"), depth, subtree)
    in_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = docs.where(training).count()
    total, vocabulary = in_words + ends, distinct + (ends > 0)
    short = words.where(F.octet_length("word") <= WORD_BYTES)
    shared = spark.sparkContext.broadcast(
        (
            {r.word: math.log10(r.n + 0.5) for r in short.where(most_frequent(short, heavy_words)).collect()},
            _sorted(strings.where(most_frequent(strings, heavy_strings)).select("string", "log10p").toArrow()),
        )
    )
    scored = materialise(_scan(docs, id_col, text_col, depth, ends > 0, shared).withColumn("row", F.monotonically_increasing_id()), "scored")
    each = math.log10(total + 0.5 * (vocabulary + 1)) if total else math.log10(0.5)
    c = F.coalesce("c", F.lit(0))
    rare_words = (
        scored.select("row", F.explode(F.arrays_zip("words", "word_times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.word_times").alias("times"))
        .join(words.withColumnRenamed("n", "c"), "word", "left")
        .select("row", (F.col("times") * F.log10(c + F.lit(0.5))).alias("base"), F.when(c > 0, F.col("times")).otherwise(0).alias("known"), F.lit(0.0).alias("gain"))
    )
    rare_strings = (
        scored.select("row", F.explode(F.arrays_zip("strings", "string_times")).alias("t")).select("row", F.col("t.strings").alias("string"), F.col("t.string_times").alias("times"))
        .join(strings.select("string", "log10p"), "string")
        .select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), (F.col("times") * F.col("log10p")).alias("gain"))
    )
    rare = rare_words.unionByName(rare_strings).groupBy("row").agg(*[F.sum(x).alias(f"rare_{x}") for x in ("base", "known", "gain")])
    score = F.col("gain") + F.coalesce("rare_gain", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        F.col("id").alias(id_col), "row", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(ends + 0.5)) + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        score.alias("score"), (-score / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    string, value = (table.column(c).to_numpy() for c in ("string", "log10p"))
    order = np.argsort(string)
    return string[order], value[order]


def _scan(docs: DataFrame, id_col: str, text_col: str, depth: int, end_known: bool, shared) -> DataFrame:
    """What the broadcast tables give of every text's scores, and its strings and words beyond them."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "known", "n_bytes")]]
        + [T.StructField(n, T.DoubleType()) for n in ("base", "gain")]
        + [T.StructField("words", T.ArrayType(T.StringType())), T.StructField("word_times", T.ArrayType(T.LongType()))]
        + [T.StructField("strings", T.ArrayType(T.LongType())), T.StructField("string_times", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, (known_strings, values) = shared.value
        known_strings = np.append(known_strings, -1)
        values = np.append(values, np.nan)
        for batch in slices(batches, CODED_BYTES):
            texts, n = batch.column("text").fill_null(""), batch.num_rows
            found, of = words_of(texts)
            logs = np.array([heavy.get(w, np.nan) for w in found.dictionary.to_numpy(zero_copy_only=False).tolist()], dtype=np.float64)
            number = found.indices.to_numpy(zero_copy_only=False)
            missing = np.isnan(logs)
            base = np.bincount(of, weights=np.where(missing, 0.0, logs)[number], minlength=n)
            known = np.bincount(of, weights=~missing[number], minlength=n).astype(np.int64) + end_known
            w, w_times, w_begins = _rare(number, of, missing, n)
            strings, coded = code(texts, depth)
            distinct = pa.array(strings).dictionary_encode()
            keys = distinct.dictionary.to_numpy()
            at = np.searchsorted(known_strings[:-1], keys)
            gains = np.where(known_strings[at] == keys, values[at], np.nan)
            number = distinct.indices.to_numpy(zero_copy_only=False)
            absent = np.isnan(gains)
            gain = np.add.reduceat(np.where(absent, 0.0, gains)[number], np.cumsum(coded) - coded)
            s, s_times, s_begins = _rare(number, np.repeat(np.arange(n), coded), absent, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.bincount(of, minlength=n) + 1, pa.int64()), pa.array(known), pa.array(coded), pa.array(base, pa.float64()), pa.array(gain, pa.float64()),
                 pa.ListArray.from_arrays(w_begins, found.dictionary.take(pa.array(w))), pa.ListArray.from_arrays(w_begins, pa.array(w_times, pa.int64())),
                 pa.ListArray.from_arrays(s_begins, pa.array(keys[s], pa.int64())), pa.ListArray.from_arrays(s_begins, pa.array(s_times, pa.int64()))],
                names=schema.names,
            )

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
