"""Data source ``mft_slots``: fixed-length slots of raw file-record tables.

A file is cut into slot ranges, one Spark partition each, so a single large file is read by many
tasks. Files are opened through Arrow's file systems, hence by any URI those know (local, hdfs, s3,
gs). A short tail is not a slot and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gainsay.sources.files import open_uri

RECORD_BYTES = 1024
SLOTS_PER_PARTITION = 64 * 1024
_SLOTS_PER_BATCH = 4096
_SCHEMA = "source_path string, record_number bigint, raw binary"


@dataclass
class SlotRange(InputPartition):
    path: str
    first: int
    count: int


class SlotReader(DataSourceReader):
    def __init__(self, paths: list[str], record_bytes: int, per_partition: int):
        self.paths, self.record_bytes, self.per_partition = paths, record_bytes, per_partition

    def partitions(self) -> list[SlotRange]:
        ranges = []
        for uri, size in self._sizes():
            slots = size // self.record_bytes
            ranges += [
                SlotRange(uri, first, min(self.per_partition, slots - first))
                for first in range(0, slots, self.per_partition)
            ]
        return ranges

    def _sizes(self) -> Iterator[tuple[str, int]]:
        """Sizes of all files, with one request per file system."""
        stores: dict[str, tuple[fs.FileSystem, list[tuple[str, str]]]] = {}
        for uri in self.paths:
            store, path = open_uri(uri)
            stores.setdefault(uri.split("://")[0] if "://" in uri else "", (store, []))[1].append((uri, path))
        for store, files in stores.values():
            found = store.get_file_info([path for _, path in files])
            for (uri, path), info in zip(files, found):
                if info.type != fs.FileType.File:
                    raise FileNotFoundError(path)
                yield uri, info.size

    def read(self, partition: SlotRange) -> Iterator[pa.RecordBatch]:
        store, path = open_uri(partition.path)
        # The same spelling as all readers give a file.
        name = path if partition.path.startswith("file:") else partition.path
        with store.open_input_file(path) as file:
            stop = partition.first + partition.count
            for first in range(partition.first, stop, _SLOTS_PER_BATCH):
                count = min(_SLOTS_PER_BATCH, stop - first)
                block = file.read_at(count * self.record_bytes, first * self.record_bytes)
                if len(block) < count * self.record_bytes:
                    raise OSError(f"{path} got shorter while it was read")
                slots = pa.Array.from_buffers(
                    pa.binary(self.record_bytes),
                    len(block) // self.record_bytes,
                    [None, pa.py_buffer(block)],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(slots), pa.string()),
                        pa.array(range(first, first + len(slots)), pa.int64()),
                        slots.cast(pa.binary()),
                    ],
                    names=["source_path", "record_number", "raw"],
                )


class SlotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mft_slots"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> SlotReader:
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        return SlotReader(
            paths,
            int(self.options.get("recordbytes", RECORD_BYTES)),
            int(self.options.get("slotsperpartition", SLOTS_PER_PARTITION)),
        )


def read_slots(
    spark: SparkSession,
    paths: list[str],
    case_id: str | Column = "case",
    record_bytes: int = RECORD_BYTES,
    slots_per_partition: int = SLOTS_PER_PARTITION,
) -> DataFrame:
    """Slots of all ``paths``; the slot's place in its file is its record number.

    ``case_id`` is a fixed text or an expression over ``source_path``.
    """
    spark.dataSource.register(SlotSource)
    return (
        spark.read.format("mft_slots")
        .option("paths", "\n".join(paths))
        .option("recordbytes", record_bytes)
        .option("slotsperpartition", slots_per_partition)
        .load()
        .withColumn("case_id", case_id if isinstance(case_id, Column) else F.lit(case_id))
    )
