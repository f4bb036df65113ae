"""Token ids in length-delimited binary record files, with offset indexes for shuffled reads.

A record file is a row of frames: length of the payload (unsigned 64 bit), masked CRC-32C of that
length, payload, masked CRC-32C of the payload; all numbers little-endian. A payload is one document:
1 or 0 (is there a doc_id), the bytes per id, the doc_id, and its ids as unsigned integers of two bytes
where the vocabulary fits in them, else of four. Beside every record
file lies an index: per frame its offset, its size, the number of ids before it in the file, and its
number of ids.

Documents are range-partitioned and sorted by doc_id; each task writes one file of its range under a
name of its own, so that a repeated or lost task leaves at most a file that no manifest names. The
manifest, one row per file, is all that reaches the driver.
"""

from __future__ import annotations

import json
import random
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.llm.common import begin, raw, slices, texts
from gainsay.llm.crc32c import masked
from gainsay.llm.tokens import SLICE_BYTES, default_path, encoder

END_ID = 1
READ_BYTES = 4 << 20
_RANGE_CHARS = 64

_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<iiq")
_INDEX = np.dtype([("offset", "<u8"), ("size", "<u8"), ("start", "<u8"), ("ids", "<u8")])
_FILE = "part bigint, name string, documents bigint, ids bigint"
RECORD = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
])
_RECORD = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


class BadRecord(ValueError):
    """A frame whose length, checksum or index does not fit."""


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return _ID.pack(doc_id is not None, width, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def document(payload: bytes) -> tuple[int | None, bytes]:
    """The doc_id, and the ids as unsigned 32-bit integers."""
    there, width, doc_id = _ID.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=_ID.size).astype("<u4")
    return doc_id if there else None, ids.tobytes()


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(lengths).tolist(), masked(payloads).tolist()
    return [
        length + struct.pack("<I", head) + payload + struct.pack("<I", tail)
        for length, head, payload, tail in zip(lengths, heads, payloads, tails)
    ]


def payloads(data: bytes) -> list[bytes]:
    """The payloads of whole frames that follow each other, with all checksums verified."""
    out, lengths, checks, at = [], [], [], 0
    while at < len(data):
        if at + _HEAD.size > len(data):
            raise BadRecord("a frame is cut off")
        size, check = _HEAD.unpack_from(data, at)
        end = at + _HEAD.size + size
        if end + 4 > len(data):
            raise BadRecord("a frame is cut off")
        lengths.append(data[at : at + 8])
        out.append(data[at + _HEAD.size : end])
        checks.append((check, int.from_bytes(data[end : end + 4], "little")))
        at = end + 4
    expected = zip(masked(lengths).tolist(), masked(out).tolist())
    if any(a != b for a, b in zip(checks, expected)):
        raise BadRecord("a checksum does not fit")
    return out


def write_records(
    docs: DataFrame,
    folder: str,
    *,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
) -> dict:
    """Write all documents in ascending doc_id order, nulls first, and return the manifest.

    ``folder`` is one that all executors share. A null or empty text is a record of ``end_id`` alone;
    repeated rows and equal ids are records of their own, ordered by text; many of one id, or without one,
    are dealt to several files by how their texts begin. A text of any length is one record. Other columns
    of ``docs`` cannot clash. An empty table gives a manifest without files.
    """
    path, end = tokenizer or default_path(), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        encode, width = encoder(path).encode, 2 if max(encoder(path).largest_id, end_id) < 1 << 16 else 4
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, index, offset, ids_before, documents = None, None, 0, 0, 0
        try:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    if out is None:
                        out = system.open_output_stream(f"{root}/{name}.records")
                        index = system.open_output_stream(f"{root}/{name}.index")
                    encoded = [ids + end for ids in encode(raw(part.column("text")))]
                    doc_ids = part.column("doc_id").to_pylist()
                    arrays = [np.frombuffer(ids, dtype="<u4") for ids in encoded]
                    framed = frames([payload(i, ids, width) for i, ids in zip(doc_ids, arrays)])
                    entries = np.zeros(len(framed), dtype=_INDEX)
                    entries["size"] = [len(f) for f in framed]
                    entries["ids"] = [len(ids) // 4 for ids in encoded]
                    entries["offset"] = offset + np.cumsum(entries["size"]) - entries["size"]
                    entries["start"] = ids_before + np.cumsum(entries["ids"]) - entries["ids"]
                    out.write(b"".join(framed))
                    index.write(entries.tobytes())
                    offset += int(entries["size"].sum())
                    ids_before += int(entries["ids"].sum())
                    documents += len(framed)
        finally:
            for stream in (out, index):
                if stream is not None:
                    stream.close()
        if documents:
            yield pa.RecordBatch.from_pydict({
                "part": [TaskContext.get().partitionId()], "name": [name],
                "documents": [documents], "ids": [ids_before],
            })

    selected = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # The beginning keeps the order of the whole texts, and the sampled bounds of the ranges small.
    by_id = F.col("doc_id").asc_nulls_first()
    ranged = selected.repartitionByRange(by_id, F.substring("text", 1, _RANGE_CHARS))
    ordered = ranged.sortWithinPartitions(by_id, "text")
    files = sorted(ordered.mapInArrow(run, _FILE).collect(), key=lambda r: r["part"])
    manifest, start = {"folder": folder, "files": []}, 0
    for row in files:
        manifest["files"].append({"name": row["name"], "documents": row["documents"], "start": start})
        start += row["ids"]
    system, root = _filesystem(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    system, root = _filesystem(folder)
    with system.open_input_stream(f"{root}/manifest.json") as source:
        return json.loads(source.read())


def _records(data: bytes, starts: list[int]) -> pa.RecordBatch:
    found = payloads(data)
    if len(found) != len(starts):
        raise BadRecord("index and records differ")
    documents = [document(p) for p in found]
    ids = [i for _, i in documents]
    return pa.RecordBatch.from_arrays([
        pa.array([key for key, _ in documents], type=pa.int64()),
        pa.array(starts, type=pa.int64()),
        pa.array([len(i) // 4 for i in ids], type=pa.int64()),
        pa.array(ids, type=pa.binary()),
    ], schema=RECORD)


def _index(system, root: str, name: str) -> np.ndarray:
    with system.open_input_stream(f"{root}/{name}.index") as source:
        return np.frombuffer(source.read(), dtype=_INDEX)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the number of ids before it over all files; one task per file.

    The files are read front to back by their frames; the index must agree with them.
    """
    files = read_manifest(folder)["files"]
    if not files:
        return spark.createDataFrame([], _RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                file = files[number]
                index = _index(system, root, file["name"])
                # Whole frames, about READ_BYTES at a time.
                cuts = np.flatnonzero(np.diff(index["offset"] // READ_BYTES)) + 1
                with system.open_input_stream(f"{root}/{file['name']}.records") as source:
                    for part in np.split(index, cuts):
                        starts = (part["start"].astype(np.int64) + file["start"]).tolist()
                        yield _records(source.read(int(part["size"].sum())), starts)
                    if source.read(1):
                        raise BadRecord("there are records beyond the index")

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, _RECORD)


def read_shuffled(spark: SparkSession, folder: str, seed: int, parts: int) -> DataFrame:
    """Every record once, dealt at random to ``parts`` tasks and in random order in each, by the index.

    A task reads the indexes, draws the same random numbers as the others, and fetches its own frames.
    It holds one file's index at a time; the order within a file's share is random, as is that of files.
    """
    files = read_manifest(folder)["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                order = list(range(len(files)))
                random.Random(f"{seed}-{part}").shuffle(order)
                for number in order:
                    file = files[number]
                    index = _index(system, root, file["name"])
                    draw = np.random.default_rng([seed, number])
                    mine = np.flatnonzero(draw.integers(parts, size=len(index)) == part)
                    mine = np.random.default_rng([seed, number, part]).permutation(mine)
                    with system.open_input_file(f"{root}/{file['name']}.records") as source:
                        for entry in index[mine]:
                            source.seek(int(entry["offset"]))
                            yield _records(
                                source.read(int(entry["size"])), [int(entry["start"]) + file["start"]]
                            )

    return spark.range(0, parts, 1, parts).mapInArrow(run, _RECORD)
