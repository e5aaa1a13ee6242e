"""Cross-tokenizer alignment: divide and conquer at byte offsets where tokens of both tokenizers end.

A is a byte-level BPE of the ``tokenizers`` library over space+text, B a ``sentencepiece`` model, which adds that space
itself. Both end a token before a single space between two other characters: A's pattern starts a new piece there, and
B has no piece with a space behind another character, which is checked when the model is loaded. So a text is cut there
into chunks, and each distinct chunk of a task is encoded by the two libraries and aligned once, however often it
occurs. A chunk may be as long as the text. Inside a chunk, a common end near the middle is looked for by bisection,
outward from the middle, and both halves are split in the same way, all intervals of all new chunks at once; an interval
without one is a leaf group.

All A-B pairs of occurrences in a group are links. A document's distinct pairs with their times are written to the shared
folder; how many documents hold a pair is one aggregation of these rows. The counts of the most frequent pairs, HEAVY_PAIRS
at most, are broadcast, those of all others are joined.

Defined cases: a null or empty text, and one whose tokens' joined bytes differ from space+text in either tokenizer, has
zeros and an empty digest; repeated rows are documents of their own; an empty table gives an empty result; columns beyond
id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import map_columns, materialise, texts_of
from strandloom.llm.ctw import most_frequent

#: Pairs whose counts are broadcast, at most; distinct chunks and their characters, beyond which a task forgets those it has met.
HEAVY_PAIRS, REMEMBERED, REMEMBERED_LETTERS = 1 << 19, 300_000, 16 << 20
#: Links of a group, beyond which pairs of its distinct ids are counted.
LARGE_GROUP = 1 << 20
#: A single space between two characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def shared_groups(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all groups, as numbers of tokens of A and of B, in order.

    ``a`` and ``b`` are ascending end offsets of the tokens of many texts laid one behind another; ``a_ends`` and ``b_ends`` tell
    how many tokens there are up to each text's end, where both end. All open intervals are looked at together: each
    bisects B for its middle A end, then for those one step further out, until one is common, and is split there; one that
    has tried all is a group.
    """
    starts = [np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a_ends, b_ends)]
    a0, a1, b0, b1 = starts[0], a_ends, starts[1], b_ends
    step, done = np.zeros(len(a0), dtype=np.int64), []
    while len(a0):
        middle = (a0 + a1 - 1) // 2
        cut, other = np.full(len(a0), -1), np.zeros(len(a0), dtype=np.int64)
        for i in (middle - step, middle + step):
            inside = np.flatnonzero((i >= a0) & (i < a1 - 1) & (cut < 0))
            j = np.searchsorted(b, a[i[inside]])
            common = b[j] == a[i[inside]]
            cut[inside[common]], other[inside[common]] = i[inside[common]] + 1, j[common] + 1
        split = cut >= 0
        tried = ~split & (middle - step < a0) & (middle + step >= a1 - 1)
        done.append((a1[tried], b1[tried]))
        wait = ~split & ~tried
        c, d = cut[split], other[split]
        a0, a1 = np.concatenate([a0[wait], a0[split], c]), np.concatenate([a1[wait], c, a1[split]])
        b0, b1 = np.concatenate([b0[wait], b0[split], d]), np.concatenate([b1[wait], d, b1[split]])
        step = np.concatenate([step[wait] + 1, np.zeros(2 * len(c), dtype=np.int64)])
    ends = [np.concatenate([np.zeros(0, dtype=np.int64), *[x[k] for x in done]]) for k in (0, 1)]
    order = np.argsort(ends[0], kind="stable")
    return ends[0][order], ends[1][order]


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are themselves, the others follow U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Chunks:
    """What is known of the distinct chunks that a task has met, by number; no tokens where bytes differ."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((4, 0), dtype=np.int64)  # tokens of A, of B, groups, links
        self.whole = np.zeros(0, dtype=bool)
        self.begins = np.zeros(1, dtype=np.int64)
        self.pairs, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.letters = 0


def _spans(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers begins[0]..ends[0]-1, begins[1]..ends[1]-1 and so on."""
    n = ends - begins
    return np.arange(int(n.sum())) + np.repeat(begins - (np.cumsum(n) - n), n)


def _summed(owner: np.ndarray, value: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value), ascending, and the sums of ``times``."""
    names, number = np.unique(value, return_inverse=True)
    keys, at = np.unique(owner * max(len(names), 1) + number, return_inverse=True)
    owner, number = np.divmod(keys, max(len(names), 1))
    return owner, names[number], np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)


@dataclass
class Aligner:
    """The two tokenizers and the chunks that a task has met."""

    a_path: str
    b_path: str
    marks: tuple[str, str] = (";", "|")  # within a group between A and B; between groups
    known: Chunks = field(default_factory=Chunks)

    def __post_init__(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(self.a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = _byte_of_letter()
        held = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in held]
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of the model spans a space; chunks would not be encoded on their own")
        self.a_size, self.b_size = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # Texts of the ids within a group, at A's end of it and at its end.
        self.texts = [f"{i}{mark}" for size, marks in ((len(self.a_bytes), "," + self.marks[0]), (len(self.b_bytes), "," + self.marks[1])) for i in range(size) for mark in marks]

    def learn(self, parts: list[str]) -> None:
        """Encode and align chunks space+part that were not met before."""
        known = self.known
        a = [e.ids for e in self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)
        whole = []
        for k, p in enumerate(parts):
            raw = b" " + p.encode("utf-8", "surrogatepass")
            whole.append(b"".join([self.a_bytes[i] for i in a[k]]) == raw == b"".join([self.b_bytes[i] for i in b[k]]))
            if not whole[-1]:
                a[k] = b[k] = []
        n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(parts)) for x in (a, b))
        a, b = (np.fromiter(itertools.chain.from_iterable(x), dtype=np.int64, count=int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        held = np.flatnonzero(n_a)
        a_ends, b_ends = np.cumsum(n_a), np.cumsum(n_b)
        a1, b1 = shared_groups(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), a_ends[held], b_ends[held])
        a0, b0 = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a1, b1))
        chunk = np.searchsorted(a_ends, a1)
        links = (a1 - a0) * (b1 - b0)
        # All pairs of a group; of a large group, pairs of its distinct ids.
        plain = np.flatnonzero(links <= LARGE_GROUP)
        at = _spans(np.zeros(len(plain), dtype=np.int64), links[plain])
        of = np.repeat(plain, links[plain])
        pairs, owner, times = [a[a0[of] + at // (b1 - b0)[of]] << 32 | b[b0[of] + at % (b1 - b0)[of]]], [chunk[of]], [np.ones(len(of), dtype=np.int64)]
        for g in np.flatnonzero(links > LARGE_GROUP).tolist():
            (x, m), (y, n) = (np.unique(z, return_counts=True) for z in (a[a0[g] : a1[g]], b[b0[g] : b1[g]]))
            pairs.append((x[:, None] << 32 | y[None, :]).ravel())
            times.append((m[:, None] * n[None, :]).ravel())
            owner.append(np.full(len(pairs[-1]), chunk[g]))
        owner, pairs, times = _summed(*map(np.concatenate, (owner, pairs, times)))
        # Ids as text, a group's A tokens before its B tokens.
        token = np.concatenate([2 * a, 2 * (len(self.a_bytes) + b)])
        token[a1 - 1] += 1
        token[len(a) + b1 - 1] += 1
        group_a, group_b = np.repeat(np.arange(len(a1)), a1 - a0), np.repeat(np.arange(len(b1)), b1 - b0)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = [self.texts[i] for i in token[order].tolist()]
        ends = np.cumsum(n_a + n_b).tolist()
        known.groups += ["".join(written[s:e]) for s, e in zip([0, *ends], ends)]
        base = len(known.number)
        known.number.update(zip(parts, range(base, base + len(parts))))
        counts = np.stack([n_a, n_b, np.bincount(chunk, minlength=len(parts)), np.bincount(chunk, weights=links, minlength=len(parts)).astype(np.int64)])
        known.counts = np.concatenate([known.counts, counts], axis=1)
        known.whole = np.concatenate([known.whole, np.array(whole, dtype=bool)])
        known.begins = np.concatenate([known.begins, len(known.pairs) + np.searchsorted(owner, np.arange(1, len(parts) + 1))])
        known.pairs, known.times = np.concatenate([known.pairs, pairs]), np.concatenate([known.times, times])
        known.letters += sum(map(len, parts))

    def documents(self, texts: list[str]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and their times of every text."""
        if len(self.known.number) > REMEMBERED or self.known.letters > REMEMBERED_LETTERS:
            self.known = Chunks()
        cut = [_CUT.split(" " + t) if t else [] for t in texts]
        for parts in cut:
            if parts:
                parts[0] = parts[0][1:]
        known = self.known
        new = list(dict.fromkeys(p for parts in cut for p in parts if p not in known.number))
        if new:
            self.learn(new)
        sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        owner = np.repeat(np.arange(len(cut)), sizes)
        chunk = np.fromiter(map(known.number.__getitem__, itertools.chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
        # Texts with a chunk whose bytes differ have no tokens.
        odd = np.bincount(owner, weights=~known.whole[chunk], minlength=len(cut)) > 0
        held = ~odd[owner]
        owner, chunk = owner[held], chunk[held]
        totals = [np.bincount(owner, weights=c[chunk], minlength=len(cut)).astype(np.int64) for c in known.counts]
        ends = np.searchsorted(owner, np.arange(len(cut) + 1)).tolist()
        numbers = chunk.tolist()
        digests = [hashlib.sha256("".join([known.groups[c] for c in numbers[s:e]])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(ends, ends[1:])]
        # Distinct pairs of each document: of its distinct chunks first, then of their pairs.
        each, of_doc = np.unique(owner * (len(known.number) + 1) + chunk, return_counts=True)
        owner, chunk = np.divmod(each, len(known.number) + 1)
        n = known.begins[chunk + 1] - known.begins[chunk]
        at = _spans(known.begins[chunk], known.begins[chunk + 1])
        doc, pairs, times = _summed(np.repeat(owner, n), known.pairs[at], known.times[at] * np.repeat(of_doc, n))
        offsets = pa.array(np.searchsorted(doc, np.arange(len(cut) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, times)]
        return [*[pa.array(t, pa.int64()) for t in totals], pa.array(digests, pa.string()), *lists]


@functools.lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str, marks: tuple[str, str]) -> Aligner:
    return Aligner(a_path, b_path, marks)


_LONG = T.LongType()
FIELDS = [
    *[T.StructField(n, _LONG) for n in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.ArrayType(_LONG)), T.StructField("times", T.ArrayType(_LONG)),
]


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of all rows of ``aligned``: rows that hold the pair, and whether no pair of the same A id has more."""
    counts = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    first = F.shiftright("pair", 32).alias("a")
    most = counts.groupBy(first).agg(F.max("n").alias("most"))
    joined = counts.select("pair", "n", first).join(most, "a")
    return materialise(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", heavy_pairs: int = HEAVY_PAIRS,
    marks: tuple[str, str] = (";", "|"),
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``marks`` are the letters of the digested text between a group's A and B ids and between groups.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        return _aligner(a_path, b_path, marks).documents(texts_of(texts))

    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    aligned = materialise(map_columns(named, run, FIELDS, ["text"], ["id"]).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = link_counts(aligned)
    heavy = most_frequent(counts, heavy_pairs)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    scored = links.join(F.broadcast(counts.where(heavy)), "pair")  # heavy_pairs rows at most
    rest = counts.where(~heavy)
    if rest.limit(1).count():
        scored = scored.unionByName(links.join(F.broadcast(counts.where(heavy).select("pair")), "pair", "left_anti").join(rest, "pair"))
    sums = scored.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    none = F.lit(0).cast("long")
    return aligned.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )
