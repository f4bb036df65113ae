"""Helpers shared by the operators: reading, staging in the shared folder, slicing Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.session import use_checkpoint_dir

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 14


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text as an empty one. Other columns cannot clash."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


_freed: dict[str, Callable[[], None]] = {}
_owners: list[str] = []


def keeps(owner: str, free: Callable[[], None]) -> None:
    """Say how to free what tasks of ``owner`` keep in this worker process for the tasks after them."""
    _freed[owner] = free


def begin(owner: str) -> None:
    """Called by a task first: frees what tasks of other operators keep in this worker process.

    Spark uses a worker for the tasks of any operator, so a cache would outlive its use.
    """
    for other in [name for name in _freed if name != owner]:
        _freed.pop(other)()
    if _owners != [owner]:
        _owners[:] = [owner]
        # Arrow's allocator keeps what it once took.
        pa.default_memory_pool().release_unused()


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the one that ``spark.checkpoint.dir`` names.

    It is removed when this process or the JVM ends, whichever comes first, the session stopped or not.
    """
    context = spark.sparkContext
    whole = f"{use_checkpoint_dir(spark).rstrip('/')}/llm-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(whole)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    folder = f"{whole}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors and repeats no work. Unlike a row
    checkpoint it is compressed and later reads take only the columns they need.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``limit`` bytes in ``column`` and bounded rows; a longer value is a piece of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if held and (held + size > limit or i - start == SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def thinned(df: DataFrame, columns: list[str], wanted: int, total: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, chosen by a hash of ``columns``: the same rows every time."""
    if total <= wanted:
        return df
    place = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))
    return df.filter(place < F.lit(wanted * (1 << 62) // total))
