"""Binary files cut into pieces."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gainsay.sources.files import list_files
from gainsay.sources.pieces import decode_pieces, fixed_chunks, marked

SCHEMA = "source_path string, offset bigint, size bigint, head string, task int"


def _lengths():
    """Made here, so that workers get the function itself and need not import this module."""

    def lengths(batches):
        from pyspark import TaskContext

        for batch in batches:
            contents = batch.column("content").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("source_path"), batch.column("offset"),
                    pa.array([len(c) for c in contents], pa.int64()),
                    pa.array([c[:8].hex() for c in contents], pa.string()),
                    pa.array([TaskContext.get().partitionId()] * len(contents), pa.int32()),
                ],
                names=["source_path", "offset", "size", "head", "task"],
            )

    return lengths


def _files(spark, folder):
    return list_files(spark, str(folder)).withColumn("case_id", F.lit("c"))


def test_a_file_beyond_two_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    size, chunk, header = (2 << 30) + 12_345, 1 << 20, 4096
    with open(tmp_path / "huge.evtx", "wb") as file:
        for n in (0, 1, 2047):
            file.seek(header + n * chunk)
            file.write(b"ElfChnk" + bytes([n % 256]))
        file.truncate(size)
    (tmp_path / "empty").touch()
    found = decode_pieces(_files(spark, tmp_path), fixed_chunks(chunk, header), _lengths(), SCHEMA).collect()
    assert sorted(r.offset for r in found) == list(range(header, size, chunk))
    assert sum(r.size for r in found) == size - header
    assert {r.offset for r in found if r.head.startswith(b"ElfChnk".hex())} == {header + n * chunk for n in (0, 1, 2047)}
    assert len({r.task for r in found}) > 8


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 10**6])
def test_pieces_are_the_same_whatever_the_ranges(spark, tmp_path, range_bytes):
    rng = random.Random(4)
    expected = set()
    for name in ("a", "b b", "é"):
        parts = [b"hbin" + rng.randbytes(rng.randrange(40)).replace(b"hbin", b"") for _ in range(12)]
        offset = 5
        for part in parts:
            expected.add((name, offset, len(part)))
            offset += len(part)
        (tmp_path / name).write_bytes(b"head:" + b"".join(parts))
    (tmp_path / "none").write_bytes(b"no mark")
    found = decode_pieces(_files(spark, tmp_path), marked(b"hbin", block=9), _lengths(), SCHEMA, range_bytes=range_bytes)
    assert sorted((r.source_path.rsplit("/", 1)[1], r.offset, r.size) for r in found.collect()) == sorted(expected)


def test_no_files(spark, tmp_path):
    assert decode_pieces(_files(spark, tmp_path), fixed_chunks(8), _lengths(), SCHEMA).count() == 0
