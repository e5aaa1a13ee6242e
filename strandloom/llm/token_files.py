"""Token ids as flat binary files with 64-bit document offsets.

Format, one pair of files a partition: ``<name>.bin`` holds the ids of its documents one after another as
little-endian unsigned integers of 2 or 4 bytes; ``<name>.idx`` holds little-endian 64-bit offsets, in ids, of
each document's first id and of the end (documents + 1 values), then the documents' keys as 64-bit integers and
one byte each that is 1 for a null key. A manifest table lists the files in order with their first id (``base``),
the prefix sum of the id counts of all files before.

Documents are encoded where they are read, and only packed ids are shuffled, to parts that are ranges of the key, so
parts and the documents in them ascend. Documents of one key (repeated rows) come in an arbitrary order and may be
split over parts; null keys come first. The number of parts follows the bytes of the texts, PART_BYTES each, so
neither a file nor a task grows with the corpus; their bounds are quantiles of the keys.
Tasks write under a name of their attempt and the manifest names only the files of the attempts that Spark kept, so a
lost executor or a second attempt leaves the result whole. Files go to a folder that all executors share; below
``file:`` they are memory-mapped on reading, elsewhere read in pieces through the file system's own reader.

Ids come from the ``tokenizers`` library: every distinct piece of a task's texts, cut at white space only or between
Latin letters and a mark after them, is encoded by it once. Defined cases: a null or empty text has only the end id;
an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from strandloom.llm.bpe import chunk_pieces, encode_batches, expand, strings_of
from strandloom.llm.common import materialise, ship_package, work_path

#: Bytes of text a part, about.
PART_BYTES = 64 << 20
#: Bytes read at once on reading back.
READ_BYTES = 16 << 20
#: Pieces of one pre-token each that the library gets in one string.
TOGETHER = 64
#: A lower-case Latin word or a mark: one pre-token, whatever stands beside it.
ONE_TOKEN = r"^(?:[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[.,;:!?])$"


class LibraryEncoder:
    """Distinct chunks -> ids, by the library's own normaliser, pre-tokeniser and model."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Ids that end a pre-token; None where the vocabulary does not tell.
        self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool) if suffix else None
        if suffix:
            self.final[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each text's."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        found = [e.ids for s in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[s : s + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum())), sizes

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and where each piece's begin."""
        joined = pc.match_substring_regex(pieces, ONE_TOKEN) if self.final is not None else pa.array([False] * len(pieces), pa.bool_())
        simple, single = pieces.filter(joined), pieces.filter(pc.invert(joined))
        bounds = pa.array([*range(0, len(simple), TOGETHER), len(simple)], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(bounds, simple), " ")
        ids, _ = self._each(strings_of(lines))
        ends = np.flatnonzero(self.final[ids]) + 1 if len(simple) else np.zeros(0, dtype=np.int64)
        if len(ends) != len(simple):
            raise ValueError("the library cut a word of letters into several pre-tokens")
        more, sizes = self._each(strings_of(single))
        mask = joined.to_numpy(zero_copy_only=False)
        lengths = np.empty(len(pieces), dtype=np.int64)
        starts = np.empty(len(pieces), dtype=np.int64)
        lengths[mask], lengths[~mask] = np.diff(ends, prepend=0), sizes
        starts[mask], starts[~mask] = ends - lengths[mask], len(ids) + np.cumsum(sizes) - sizes
        begins = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(starts - begins[:-1], lengths) + np.arange(begins[-1])
        return np.concatenate([ids, more])[where], begins

    def encode_chunks(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after another, and where each chunk's begin (one more for the end)."""
        pieces, codes, begins = chunk_pieces(chunks, lambda chunk: [chunk])
        flat, spans = expand(codes, *self._pieces(pieces))
        return flat, spans[begins]


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One encoder a worker process and vocabulary."""
    return LibraryEncoder(path)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, path


MANIFEST = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_ids", T.LongType()),
    ]
)


def key_bounds(docs: DataFrame, key_col: str, text_col: str, part_bytes: int) -> np.ndarray:
    """Ascending bounds of the parts, one fewer than there are parts; a hot key may be several bounds."""
    sized = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.octet_length(f"`{text_col}`").alias("size"))
    total = sized.agg(F.sum(F.coalesce("size", F.lit(0)).cast("long") + 16)).first()[0] or 0
    n = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // part_bytes))
    found = sized.select("key").approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n) if total else []
    return np.array(found, dtype=np.int64)


def packed_ids(docs: DataFrame, vocab_path: str, key_col: str, text_col: str, end_id: int, width: int, bounds: np.ndarray) -> DataFrame:
    """(part, key, tie, ids): every whole text's ids and the end id, packed little-endian; ``tie`` orders rows of one key."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"))
    kind = np.dtype(f"<u{width}")
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for (key,), ids, begins in encode_batches(batches, "text", ["key"], library_encoder(vocab_path).encode_chunks):
            ids = np.insert(ids, begins[1:], end_id)
            if ids.max(initial=0) >= 1 << 8 * width:
                raise ValueError(f"id {ids.max()} does not fit into {width} bytes")
            ends = ((begins + np.arange(len(begins))) * width).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(kind))])
            # An odd multiplier spreads the row numbers evenly over 63 bits.
            tie = (np.arange(row, row + len(key), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)
            row += len(key)
            value = key.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = (np.searchsorted(shared.value, value, side=side) for side in ("left", "right"))
            part = low + ((high - low + 1) * (tie / 2.0**63)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(part, high)), key, pa.array(tie), packed], names=["part", "key", "tie", "ids"])

    return source.mapInArrow(run, "part long, key long, tie long, ids binary")


class FileWriter:
    """One part's pair of files."""

    def __init__(self, fs: pafs.FileSystem, root: str, name: str, width: int):
        fs.create_dir(root, recursive=True)
        self.fs, self.path, self.width = fs, f"{root}/{name}", width
        self.lengths, self.keys, self.nulls = [], [], []
        self.sink = fs.open_output_stream(f"{self.path}.bin")

    def add(self, key: pa.Array, ids: pa.Array) -> None:
        self.keys.append(key.fill_null(0).to_numpy(zero_copy_only=False))
        self.nulls.append(key.is_null().to_numpy(zero_copy_only=False))
        self.lengths.append(pc.binary_length(ids).to_numpy(zero_copy_only=False) // self.width)
        self.sink.write(pc.binary_join(pa.ListArray.from_arrays([0, len(ids)], ids), b"")[0].as_buffer())

    def close(self) -> tuple[int, int]:
        """Numbers of documents and of ids."""
        self.sink.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths), dtype=np.int64)]).astype("<i8")
        with self.fs.open_output_stream(f"{self.path}.idx") as out:
            out.write(offsets.tobytes())
            out.write(np.concatenate(self.keys).astype("<i8").tobytes())
            out.write(np.concatenate(self.nulls).astype("u1").tobytes())
        return len(offsets) - 1, int(offsets[-1])


def write_token_files(
    docs: DataFrame, folder: str, vocab_path: str, key_col: str = "doc_id", text_col: str = "text",
    end_id: int = 2, width: int = 4, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Encode and write all documents in ascending key order; returns the manifest with prefix-sum bases."""
    if width not in (2, 4):
        raise ValueError("width must be 2 or 4 bytes")
    bounds = key_bounds(docs, key_col, text_col, part_bytes)
    encoded = packed_ids(docs, vocab_path, key_col, text_col, end_id, width, bounds)
    ordered = encoded.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "tie").select("part", "key", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        fs, root = _open(folder)
        attempt = f"{ctx.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        names = [f.name for f in MANIFEST.fields]
        at, writer = None, None

        def done() -> pa.RecordBatch:
            n_docs, n_ids = writer.close()
            return pa.RecordBatch.from_pylist([dict(zip(names, (at, f"part-{at:06d}-{attempt}", n_docs, n_ids)))])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if parts[s] != at:
                    if writer:
                        yield done()
                    at = int(parts[s])
                    writer = FileWriter(fs, root, f"part-{at:06d}-{attempt}", width)
                writer.add(batch.column("key").slice(s, e - s), batch.column("ids").slice(s, e - s))
        if writer:
            yield done()

    manifest = materialise(ordered.mapInArrow(write, MANIFEST), "manifest")
    # One row a file: the window's single task reads as many rows as there are partitions.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Flat:
    """Spans of a flat file's values: memory-mapped below ``file:``, read in pieces elsewhere."""

    def __init__(self, fs: pafs.FileSystem, path: str, local: bool):
        self.file = pa.memory_map(path) if local and fs.get_file_info(path).size else fs.open_input_file(path)

    def values(self, kind: str, at: int, count: int) -> np.ndarray:
        """``count`` values from byte ``at`` on."""
        dtype = np.dtype(kind)
        return np.frombuffer(self.file.read_at(count * dtype.itemsize, at), dtype=dtype) if count else np.zeros(0, dtype=dtype)


def read_token_files(manifest: DataFrame, folder: str, width: int = 4, key_col: str = "doc_id") -> DataFrame:
    """One row a document, read back from the files: key, start, n_tokens and crc32 of its ids as 4-byte integers."""
    schema = T.StructType(
        [T.StructField(key_col, T.LongType())]
        + [T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]
    )

    def one(fs: pafs.FileSystem, path: str, local: bool, n_docs: int, base: int) -> Iterator[pa.RecordBatch]:
        ids, index = Flat(fs, f"{path}.bin", local), Flat(fs, f"{path}.idx", local)
        at = 0
        while at < n_docs:
            offsets = index.values("<i8", 8 * at, min(n_docs - at, READ_BYTES // 256) + 1)
            # As many documents as READ_BYTES hold; a longer one comes alone.
            n = max(1, int(np.searchsorted(offsets, offsets[0] + READ_BYTES // width, side="right")) - 1)
            offsets = offsets[: n + 1]
            keys = index.values("<i8", 8 * (n_docs + 1 + at), n)
            nulls = index.values("u1", 8 * (2 * n_docs + 1) + at, n).astype(bool)
            span = ids.values(f"<u{width}", width * int(offsets[0]), int(offsets[-1] - offsets[0])).astype("<u4")
            view = memoryview(span.view(np.uint8))
            cuts = (4 * (offsets - offsets[0])).tolist()
            crc = [zlib.crc32(view[s:e]) for s, e in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, mask=nulls), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())],
                names=schema.names,
            )
            at += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        local = urlparse(folder).scheme in ("", "file")
        for batch in batches:
            for name, n_docs, base in zip(*(batch.column(c).to_pylist() for c in ("name", "n_docs", "base"))):
                yield from one(fs, f"{root}/{name}", local, n_docs, base)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(n, "part").mapInArrow(read, schema)


def token_folder(docs: DataFrame) -> str:
    """A new folder for token files below the shared folder."""
    return work_path(docs.sparkSession, "tokens")
