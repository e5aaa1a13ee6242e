"""BPE encoding with a pair occurrence index, and decoding.

The texts of a partition are split at ASCII white space and every distinct chunk is numbered, so that a text is a row
of chunk numbers. The distinct pre-tokens of all chunks are laid out as one symbol sequence. An index maps each
mergeable pair to all its positions; the active ranks are taken in ascending order from a heap, every occurrence of
the pair is merged, in one array step where there are many, and only the lists of the neighbouring pairs are updated.

A partition whose chunk numbers and distinct chunks exceed HELD_BYTES is encoded in several such parts, each with its
own index, so memory does not follow the size of a split.

The vocabulary file is the JSON form of the ``tokenizers`` library; its path is a parameter and the file must be
readable on every executor. Supported form: an optional NFC / white space / lower case normaliser chain, a
removing Split pre-tokeniser followed by ByteLevel, BPE with an end-of-word suffix, no decoder.

Defined cases: a null or empty text has no ids and decodes to the empty text; ids decode to their tokens joined
by one space, as the library does without a decoder; special tokens written in a text become their ids; an id
outside the vocabulary is left out of the decoded text; rows are handled one by one, so repeated rows repeat
their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from strandloom.llm.common import map_columns, ship_package, slices

#: Separators that Python's patterns take for white space although Unicode's White_Space leaves them out.
NOT_SPACE = re.compile("[\x1c-\x1f]")

#: Marks that end a chunk of letters, and such chunks: Latin letters with one form under NFC in every Unicode version.
MARKS = ".,;:!?"
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[.,;:!?]?$"

#: Bytes of chunk numbers and distinct chunks that a task holds before it encodes them.
HELD_BYTES = 64 << 20
#: Bytes of memory that a distinct chunk and its pre-tokens take, about.
CHUNK_BYTES = 100
#: Occurrences from which a rank is merged by array operations.
MANY = 24
#: Rank of a pair that does not merge.
NO_RANK = np.int32(2**31 - 1)


class PreTokenizer:
    """Chunk -> pre-tokens, as the vocabulary file prescribes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.spec = spec
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.to_bytes = {v: k for k, v in byte_symbols().items()}

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of one chunk; a special token stands as itself, which no other pre-token can."""
        if "<" not in chunk or not self.special_re.search(chunk):
            return self._plain(chunk)
        out: list[str] = []
        at = 0
        for m in self.special_re.finditer(chunk):
            out += self._plain(chunk[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(chunk[at:])

    def _plain(self, chunk: str) -> list[str]:
        if not chunk:
            return []
        # One form under NFC, stable in every Unicode version.
        if (chunk.isascii() or max(chunk) < "\u0100") and not NOT_SPACE.search(chunk):
            return self.pieces.findall(chunk.lower())
        t = self.tokenizer
        found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk))
        return [bytes(map(self.to_bytes.__getitem__, w)).decode() for w, _ in found]


def chunk_pieces(chunks: pa.StringArray, other: Callable[[str], list[str]]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct pieces of the chunks, piece numbers of all chunks one after another, and where each chunk's begin.

    A chunk of Latin letters, with a mark at its end or not, is its lower-case letters and the mark; ``other`` cuts the rest.
    """
    plain = pc.match_substring_regex(chunks, PLAIN)
    letters = pc.utf8_rtrim(chunks.filter(plain), MARKS)
    ends = chunks.filter(plain)
    marked = pc.not_equal(pc.binary_length(ends), pc.binary_length(letters))
    marks = pc.utf8_slice_codeunits(ends.filter(marked), -1)
    cut = [other(c) for c in strings_of(chunks.filter(pc.invert(plain)))]
    plain, marked = (x.to_numpy(zero_copy_only=False) for x in (plain, marked))
    sizes = np.ones(len(chunks), dtype=np.int64)
    sizes[np.flatnonzero(plain)[marked]] = 2
    sizes[~plain] = [len(c) for c in cut]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    rest = pa.array(list(itertools.chain.from_iterable(cut)), pa.string())
    pieces = pa.concat_arrays([pc.utf8_lower(letters), marks, rest]).dictionary_encode()
    number = pieces.indices.to_numpy(zero_copy_only=False)
    codes = np.empty(begins[-1], dtype=np.int32)
    first = begins[:-1][plain]
    codes[first] = number[: len(first)]
    codes[first[marked] + 1] = number[len(first) : len(first) + len(marks)]
    lengths = sizes[~plain]
    inside = np.arange(len(rest)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes[np.repeat(begins[:-1][~plain], lengths) + inside] = number[len(first) + len(marks) :]
    return pieces.dictionary, codes, begins


def strings_of(column: pa.Array) -> list[str]:
    """The column as Python strings."""
    return column.to_numpy(zero_copy_only=False).tolist()


def byte_symbols() -> dict[int, str]:
    """Byte -> printable character, the public byte-level alphabet."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def expand(codes: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code's span one after another, and where each code's values begin (one more for the end)."""
    starts = offsets[codes]
    lengths = offsets[codes + 1] - starts
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - begins[:-1], lengths) + np.arange(begins[-1])], begins


class PairIndexBPE:
    """Merges all words at once through an index of pair occurrences."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbol = byte_symbols()
        #: Ids of the 256 bytes inside a word, then at its end.
        self.first = np.array([vocab[symbol[b]] for b in range(256)] + [vocab[symbol[b] + suffix] for b in range(256)], dtype=np.int32)
        self.rank: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for r, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b = vocab[left], vocab[right]
            self.rank.setdefault(a << 32 | b, r)
            self.rules.append((a, b, vocab[left + right]))
        keys = np.array(sorted(self.rank), dtype=np.int64)
        self.keys, self.ranks = keys, np.array([self.rank[k] for k in keys.tolist()], dtype=np.int32)
        lowest: dict[int, int] = {}
        for k, r in self.rank.items():
            for s in (k >> 32, k & 0xFFFFFFFF):
                lowest[s] = min(r, lowest.get(s, r))
        #: Rules whose result is in no pair of lower rank and whose occurrences cannot overlap: all merge at once.
        self.at_once = [a != b and lowest.get(c, r + 1) > r for r, (a, b, c) in enumerate(self.rules)]
        pairs = self.first.astype(np.int64)
        self.table = self._ranks_of(pairs[:, None] << 32 | pairs[None, :])

    def _ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(pairs.shape, NO_RANK)
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], NO_RANK)

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and where each word's begin (one more for the end)."""
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "")[0].as_buffer(), dtype=np.uint8)
        ends = np.cumsum(lengths)
        last = np.zeros(len(data), dtype=bool)
        last[ends[lengths > 0] - 1] = True
        code = data.astype(np.int32) + 256 * last
        sym, n = self.first[code], len(data)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[last] = -1
        prv[np.flatnonzero(last)[:-1] + 1] = -1
        found = self.table[code[:-1], code[1:]]
        found[last[:-1]] = NO_RANK
        self._merge(sym, nxt, prv, np.arange(len(found), dtype=np.int32), found)
        alive = sym >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], count[np.concatenate([[0], ends])]

    def _merge(self, sym: np.ndarray, nxt: np.ndarray, prv: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
        rules, occ, active = self.rules, {}, []
        self._note(occ, active, at, ranks)
        merged = np.zeros(len(sym), dtype=bool)
        views = memoryview(sym), memoryview(nxt), memoryview(prv)
        while active:
            r = heapq.heappop(active)
            where = occ.pop(r)
            if len(where) < MANY or not self.at_once[r]:
                self._merge_each(r, sorted(where), *views, occ, active)
                continue
            a, b, c = rules[r]
            p = np.array(where, dtype=np.int32)
            q = nxt[p]
            here = (sym[p] == a) & (q >= 0) & (sym[q] == b)
            p, q = p[here], q[here]
            after = nxt[q]
            sym[p], sym[q], nxt[p] = c, -1, after
            follows = after >= 0
            prv[after[follows]] = p[follows]
            before = prv[p]
            before = before[before >= 0]
            merged[p] = True  # such a neighbour's pair is entered as its right one
            before = before[~merged[before]]
            merged[p] = False
            left = np.concatenate([p[follows], before])
            right = np.concatenate([after[follows], nxt[before]])
            self._note(occ, active, left, self._ranks_of(sym[left].astype(np.int64) << 32 | sym[right]))

    @staticmethod
    def _note(occ: dict[int, list[int]], active: list[int], at: np.ndarray, ranks: np.ndarray) -> None:
        """Enter the positions under their ranks."""
        held = ranks != NO_RANK
        at, ranks = at[held], ranks[held]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order].tolist(), ranks[order]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if len(ranks) else np.zeros(0, dtype=np.int64)
        spans = [*starts.tolist(), len(at)]
        for i, r in enumerate(ranks[starts].tolist()):
            if r in occ:
                occ[r] += at[spans[i] : spans[i + 1]]
            else:
                occ[r] = at[spans[i] : spans[i + 1]]
                heapq.heappush(active, r)

    def _merge_each(self, r: int, where: list[int], sym: memoryview, nxt: memoryview, prv: memoryview, occ: dict[int, list[int]], active: list[int]) -> None:
        rank_of = self.rank.get
        a, b, c = self.rules[r]
        for done, p in enumerate(where, 1):
            if sym[p] != a:
                continue
            q = nxt[p]
            if q < 0 or sym[q] != b:
                continue
            sym[p], sym[q] = c, -1
            after = nxt[p] = nxt[q]
            lower = False
            if after >= 0:
                prv[after] = p
                k = rank_of(c << 32 | sym[after])
                if k is not None:
                    if k in occ:
                        occ[k].append(p)
                    else:
                        occ[k] = [p]
                        heapq.heappush(active, k)
                    lower = k < r
            before = prv[p]
            if before >= 0:
                k = rank_of(sym[before] << 32 | c)
                if k is not None:
                    if k in occ:
                        occ[k].append(before)
                    else:
                        occ[k] = [before]
                        heapq.heappush(active, k)
                    lower = lower or k < r
            if lower and done < len(where):  # a new pair of lower rank goes first; the rest waits
                if r in occ:
                    occ[r] += where[done:]
                else:
                    occ[r] = where[done:]
                    heapq.heappush(active, r)
                break


class Encoder:
    """Distinct chunks -> ids, through the pair index."""

    def __init__(self, path: str):
        self.pre = PreTokenizer(path)
        self.bpe = PairIndexBPE(self.pre.spec)

    def encode_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and where each chunk's begin (one more for the end)."""
        pieces, codes, begins = chunk_pieces(chunks, self.pre.words)
        special = pc.is_in(pieces, pa.array(list(self.pre.special), pa.string()))
        ids, at = self.bpe.encode(pc.if_else(special, "", pieces))
        where = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        if len(where):
            ids = np.insert(ids, at[where], [self.pre.special[pieces[i].as_py()] for i in where.tolist()])
            at[1:] += np.cumsum(np.bincount(where, minlength=len(pieces)))
        flat, spans = expand(codes, ids, at)
        return flat, spans[begins]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(path)


Chunks = Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]


def encode_batches(batches: Iterator[pa.RecordBatch], text_col: str, keep: list[str], encode: Chunks) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """(kept columns, ids of all rows, where each row's begin) for slices of a task's batches.

    Texts are held as chunk numbers; all distinct chunks held are encoded together.
    """
    held: list[tuple[list[pa.Array], np.ndarray]] = []
    coded: list[pa.DictionaryArray] = []
    size = 0

    def out() -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
        parts = pa.chunked_array(coded).unify_dictionaries().chunks
        values, offsets = encode(parts[0].dictionary)
        for (columns, begins), part in zip(held, parts):
            ids, at = expand(part.indices.to_numpy(zero_copy_only=False), values, offsets)
            yield columns, ids, at[begins]

    for batch in slices(batches):
        chunks = pc.ascii_split_whitespace(batch.column(text_col).fill_null(""))
        begins = np.concatenate([[0], np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        coded.append(chunks.flatten().dictionary_encode())
        # Copies, so that the slice's batch is not held.
        held.append(([pa.concat_arrays([batch.column(c), batch.column(c).slice(0, 0)]) for c in keep], begins))
        size += coded[-1].indices.nbytes + begins.nbytes + CHUNK_BYTES * len(coded[-1].dictionary)
        if size > HELD_BYTES:
            yield from out()
            held, coded, size = [], [], 0
    if held:
        yield from out()


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> pa.Array:
    """Id -> token, null for an id without one."""
    spec = json.load(open(path, encoding="utf-8"))
    vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    table: list[str | None] = [None] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = token
    return pa.array(table, pa.string())


def decode_ids(ids: np.ndarray, begins: np.ndarray, path: str) -> pa.Array:
    """The tokens of every row's ids joined by one space."""
    table = token_table(path)
    known = (ids >= 0) & (ids < len(table))
    tokens = table.take(pa.array(np.where(known, ids, 0)))
    if table.null_count or not known.all():
        known &= tokens.is_valid().to_numpy(zero_copy_only=False)
        tokens, begins = tokens.filter(pa.array(known)), np.concatenate([[0], np.cumsum(known)])[begins]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), tokens), " ")


def bpe_round_trip(docs: DataFrame, vocab_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """Append the ids of every whole text and, unless ``decoded_col`` is None, the text they decode to; one pass."""
    ship_package(docs.sparkSession)
    kept = list(keep)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    fields += [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [f"k{i}" for i in range(len(kept))]
        for columns, ids, begins in encode_batches(batches, "text", held, encoder(vocab_path).encode_chunks):
            made = [pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids, pa.int32()))]
            made += [decode_ids(ids, begins, vocab_path)] if decoded_col else []
            yield pa.RecordBatch.from_arrays([*columns, *made], names=schema.names)

    return source.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, vocab_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Append the ids of every whole text."""
    return bpe_round_trip(docs, vocab_path, text_col, keep, ids_col, None)


def bpe_decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids"), decoded_col: str = "decoded") -> DataFrame:
    """Append the decoded text of every row's ids; null ids decode to the empty text."""

    def run(ids: pa.Array) -> list[pa.Array]:
        begins = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return [decode_ids(flat, begins, vocab_path)]

    return map_columns(encoded, run, [T.StructField(decoded_col, T.StringType())], [ids_col], list(keep))
