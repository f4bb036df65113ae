"""Data source ``case_files``: the regular files below a folder.

Spark's own file listing leaves out empty files and names that start with a dot or underscore, all
of which may be evidence. The driver goes down the folders level by level until there are enough of
them to deal out, each a task; a task lists its folder one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "path string, length bigint, modificationTime timestamp"
_FILES_PER_BATCH = 10_000
_ENOUGH_FOLDERS = 256


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of any kind Arrow knows (local, hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path)
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


def _folders(store: fs.FileSystem, folder: str) -> list[str]:
    below = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in below if f.type == fs.FileType.Directory)


def _files(store: fs.FileSystem, folder: str, recursive: bool) -> Iterator[fs.FileInfo]:
    """Files of a folder, then those of the folders below it: one folder's entries in memory at a time."""
    waiting = [folder]
    while waiting:
        entries = store.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True))
        yield from (f for f in entries if f.type == fs.FileType.File)
        if recursive:
            waiting += [f.path for f in entries if f.type == fs.FileType.Directory]


def _batches(files: Iterator[fs.FileInfo]) -> Iterator[list[fs.FileInfo]]:
    while some := list(islice(files, _FILES_PER_BATCH)):
        yield some


class FileReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def partitions(self) -> list[Folder]:
        store, path = open_uri(self.root)
        if store.get_file_info(path).type != fs.FileType.Directory:
            raise ValueError(f"no such folder: {self.root}")
        done, level = [], [path]
        while level and len(done) + len(level) < _ENOUGH_FOLDERS:
            done += level
            level = [f for folder in level for f in _folders(store, folder)]
        return [*(Folder(f, False) for f in done), *(Folder(f, True) for f in level)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, root = open_uri(self.root)
        prefix = self.root[: -len(root)] if self.root.endswith(root) else ""
        for some in _batches(_files(store, partition.path, partition.recursive)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([prefix + f.path for f in some], pa.string()),
                    pa.array([f.size for f in some], pa.int64()),
                    pa.array([f.mtime for f in some], pa.timestamp("us", tz="UTC")),
                ],
                names=["path", "length", "modificationTime"],
            )


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "case_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(FileSource)
    return spark.read.format("case_files").option("path", folder).load()
