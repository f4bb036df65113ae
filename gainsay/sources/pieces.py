"""Large binary files cut into pieces that a caller's decoder reads, without any file whole in memory.

A file is dealt out as byte ranges, each a row of its own, so one huge file is the work of many tasks. A splitter
says where in a range pieces begin; a piece belongs to the range it begins in and may reach beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from gainsay.sources.files import open_uri

RANGE_BYTES = 128 << 20
_BATCH_BYTES = 8 << 20
_BATCH_ROWS = 1024
_MOST_TASKS = 100_000

ReadAt = Callable[[int, int], bytes]
# From a reader (offset, size), the range's start and stop, and the file's length to (offset, size) of its pieces.
Splitter = Callable[[ReadAt, int, int, int], Iterator[tuple[int, int]]]


def fixed_chunks(size: int, header: int = 0) -> Splitter:
    """Chunks of one size after a header; the last one may be shorter."""

    def split(read_at: ReadAt, start: int, stop: int, length: int) -> Iterator[tuple[int, int]]:
        first = header + max(0, -(-(start - header) // size)) * size
        for offset in range(first, min(stop, length), size):
            yield offset, min(size, length - offset)

    return split


def marked(marker: bytes, block: int = 4 << 20) -> Splitter:
    """Pieces that begin with ``marker`` and end where the next one begins, or with the file."""

    def places(read_at: ReadAt, start: int, length: int) -> Iterator[int]:
        """Beginnings from ``start`` on; blocks overlap, so none is cut in two."""
        reach = len(marker) - 1
        for at in range(start, length, block):
            data = read_at(at, min(block + reach, length - at))
            found = data.find(marker)
            while found >= 0:
                yield at + found
                found = data.find(marker, found + 1)

    def split(read_at: ReadAt, start: int, stop: int, length: int) -> Iterator[tuple[int, int]]:
        begin = None
        for place in places(read_at, start, length):
            if begin is not None:
                yield begin, place - begin
            begin = place
            if place >= stop:
                return
        if begin is not None:
            yield begin, length - begin

    return split


def decode_pieces(
    files: DataFrame,
    splitter: Splitter,
    decoder: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: StructType | str,
    *,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Rows of ``schema`` that ``decoder`` makes of the pieces of ``files`` (``path``, ``length``, ``case_id``).

    The decoder takes Arrow batches (source_path, case_id, offset, content) of some megabytes, or one larger piece. A
    batch may hold pieces of several ranges. Empty files and ranges without a piece give nothing; a file that became
    shorter than its listed length is an error. Paths are rows throughout, and any number of them will do: only
    their count comes to the driver, to say how many tasks there are.
    """
    usable = files.filter(F.col("length") > 0)
    count = usable.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0] or 0
    ranges = usable.select(
        F.col("path").alias("source_path"), "case_id", F.col("length").cast("bigint").alias("length"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length").cast("bigint") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"),
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        return decoder(_pieces(batches, splitter, range_bytes))

    # An explicit number: adaptive execution would put these small rows into one task.
    return ranges.repartition(max(1, min(int(count), _MOST_TASKS))).mapInArrow(run, schema)


def _pieces(batches: Iterable[pa.RecordBatch], splitter: Splitter, range_bytes: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            store, path = open_uri(row["source_path"])
            with store.open_input_file(path) as file:

                def read_at(offset: int, wanted: int) -> bytes:
                    data = file.read_at(wanted, offset)
                    if len(data) < wanted:
                        raise OSError(f"{path} got shorter while it was read")
                    return data

                stop = min(row["start"] + range_bytes, row["length"])
                for offset, wanted in splitter(read_at, row["start"], stop, row["length"]):
                    held.append((row["source_path"], row["case_id"], offset, read_at(offset, wanted)))
                    size += wanted
                    if size >= _BATCH_BYTES or len(held) == _BATCH_ROWS:
                        yield _batch(held)
                        held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[tuple[str, str, int, bytes]]) -> pa.RecordBatch:
    paths, cases, offsets, contents = zip(*held)
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(cases, pa.string()), pa.array(offsets, pa.int64()), pa.array(contents, pa.large_binary())],
        names=["source_path", "case_id", "offset", "content"],
    )
