"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A word is a maximal run of characters outside space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()
#: Paths of the work tables made so far.
_CREATED: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python path, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on one machine a temporary one where it is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.getCheckpointDir() and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/work-{name}-{uuid.uuid4().hex}"
    _CREATED.append(path)
    return path


@contextlib.contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the work tables made meanwhile; what is computed from them must be written elsewhere by then."""
    known = len(_CREATED)
    yield
    while len(_CREATED) > known:
        delete_folder(spark, _CREATED.pop())


#: Setting under which Spark deletes a query's shuffle files as soon as it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_freed(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; its shuffle files, which no other plan reads, go when it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_FREED)
    conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_FREED, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the reading of its splits.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    write_freed(df, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the work tables that ``df`` reads; only for frames no later plan depends on."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/work-" in path:
            delete_folder(df.sparkSession, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(key: Column, k: int = 5) -> Column:
    """crc32 of the key as text, modulo ``k``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(k))


#: Arrow bytes that a Python function gets at once; a single longer row comes alone.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The non-empty batches, cut so that working memory does not follow the batch size."""
    for batch in batches:
        rows = max(1, batch.num_rows * (limit or SLICE_BYTES) // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_columns(
    df: DataFrame,
    fn: Callable[..., Sequence[pa.Array]],
    fields: list[T.StructField],
    inputs: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    """Append Arrow-computed columns row by row, without a shuffle.

    ``fn`` gets the columns ``inputs`` of a batch as Arrow arrays and returns one array per field;
    the columns ``keep`` pass through. Only the columns named are read.
    """
    ship_package(df.sparkSession)
    columns = list(dict.fromkeys([*keep, *inputs]))
    source = df.select(*[F.col(f"`{c}`") for c in columns])
    schema = T.StructType([source.schema[c] for c in keep] + fields)
    names = [f.name for f in schema.fields]
    inputs, keep = list(inputs), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = fn(*[batch.column(c) for c in inputs])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=names)

    return source.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]
