"""Data source ``report_files`` (write only): one text file per case and source, its lines in the order of the rows.

Tasks write below a staging folder whose name readers skip. Only when all tasks are through does the driver move the
files of the attempts that count to their places; a job that fails leaves nothing behind, also not of the tasks that
had finished. (The moves are one by one: a driver lost among them leaves the files moved so far.) Rows must come sorted by case and source (``gainsay.plans.reports.write_report_files`` sees to it); a
source that goes on in the next task has its further lines in a file with the next number.

With the option ``listing`` the files written are listed there, a JSON object a line. With ``joined``, a folder written
so, the values are not lines but the names of its files, whose bytes follow each other in the file of the source.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from gainsay.sources.files import open_uri

COLUMNS = ("case_id", "source_path", "value")
LISTED = "case_id string, source_path string, place int, file string"
_LONGEST_NAME = 160
_MOVES_AT_ONCE = 16
_COPIED_BYTES = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    """Where a task listed its files; the list itself stays in the shared folder."""

    partition: int
    manifest: str


def file_stem(case_id: str | None, source_path: str | None) -> str:
    """Folder and beginning of the name of a source's files: escaped, and cut with a digest where too long."""
    names = []
    for key, value in (("case", case_id), ("report", source_path)):
        if value is None:
            names.append(f"{key}=__HIVE_DEFAULT_PARTITION__")
            continue
        name = quote(value, safe=" $")
        if len(name) > _LONGEST_NAME:
            name = f"{name[:_LONGEST_NAME]}~{hashlib.sha256(value.encode()).hexdigest()}"
        names.append(f"{key}={name}")
    return "/".join(names)


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, listing: str | None = None, joined: str | None = None):
        self.path, self.overwrite, self.listing, self.joined = path.rstrip("/"), overwrite, listing, joined
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        # The attempt's own folder: a repeated or speculative task never meets another one's files.
        attempt = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        store, folder = open_uri(attempt)
        store.create_dir(folder, recursive=True)
        manifest = f"{folder}/files"
        number, current, out = 0, None, None
        with store.open_output_stream(manifest) as listing:
            for batch in iterator:
                for source, values in _runs(batch):
                    if source != current or out is None:
                        if out is not None:
                            out.close()
                        name = f"{number}.part"
                        out, current, number = store.open_output_stream(f"{folder}/{name}"), source, number + 1
                        listing.write((json.dumps([*source, name]) + "\n").encode())
                    if self.joined is not None:
                        for value in values:
                            _copy(self.joined, value, out)
                    else:
                        out.write("".join(f"{v or ''}\n" for v in values).encode())
            if out is not None:
                out.close()
        return Written(context.partitionId(), manifest)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_uri(self.path)
        moves, listed, last, place = [], [], None, 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            folder = message.manifest.rsplit("/", 1)[0]
            with store.open_input_stream(message.manifest) as listing:
                for line in listing.read().decode().splitlines():
                    case_id, source_path, name = json.loads(line)
                    place = place + 1 if (case_id, source_path) == last else 0
                    last = (case_id, source_path)
                    target = f"{file_stem(*last)}.{place:05d}.html"
                    moves.append((f"{folder}/{name}", f"{root}/{target}"))
                    listed.append((*last, place, target))
        if len({target for _, target in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of one source do not lie together: sort them by case_id and source_path")
        before = [f for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("case=")]
        if self.overwrite:
            for old in before:
                store.delete_dir(old.path)
        else:
            taken = store.get_file_info([target for _, target in moves])
            if any(f.type != fs.FileType.NotFound for f in taken):
                self.abort(messages)
                raise FileExistsError(f"{self.path} has reports of these sources")
        for folder in {target.rsplit("/", 1)[0] for _, target in moves}:
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(_MOVES_AT_ONCE) as pool:
            list(pool.map(lambda move: store.move(*move), moves))
        if self.listing is not None:
            names = [part.split()[0] for part in LISTED.split(", ")]
            folder, listing = open_uri(self.listing)
            with folder.open_output_stream(listing) as out:
                for row in listed:
                    out.write((json.dumps(dict(zip(names, row))) + "\n").encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove whatever is staged."""
        store, folder = open_uri(self.staging)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def _copy(folder: str, file: str, out) -> None:
    store, root = open_uri(folder)
    with store.open_input_stream(f"{root.rstrip('/')}/{file}") as piece:
        while some := piece.read(_COPIED_BYTES):
            out.write(some)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str | None, str | None], list[str | None]]]:
    """Values of neighbouring rows of one source."""
    cases, sources, values = (batch.column(c).to_pylist() for c in COLUMNS)
    begin = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or cases[i] != cases[begin] or sources[i] != sources[begin]:
            yield (cases[begin], sources[begin]), values[begin:i]
            begin = i


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_files"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if tuple(schema.names) != COLUMNS:
            raise ValueError(f"report files are written from the columns {', '.join(COLUMNS)}")
        return ReportWriter(self.options["path"], overwrite, self.options.get("listing"), self.options.get("joined"))
