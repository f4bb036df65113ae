"""File-record slots: every branch of the byte walk, and the scan of slot files."""

import struct
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from slots import attribute, file_name, slot, standard

from gainsay import schemas
from gainsay.operators import slots as decoder
from gainsay.sources import case
from gainsay.sources.slots import read_slots

MADE = datetime(2019, 2, 28, 17, 45)
OLD = datetime(2003, 11, 5)
SECOND = timedelta(seconds=1)


@pytest.fixture(scope="module")
def decode(spark):
    def run(*raws):
        df = spark.createDataFrame([("c", "f", i, r) for i, r in enumerate(raws)], schemas.MFT_SLOTS)
        return decoder.decode(df).orderBy("record_number").collect()

    return run


def test_ordinary_directory_and_backdated_records(decode):
    first, next_year = datetime(1999, 12, 31, 23, 59, 58), datetime(2000, 7, 8, 1, 2, 3)
    rows = decode(
        slot(standard(first, next_year, next_year, next_year), file_name("tide tables.csv", 1, first)),
        slot(standard(first, first, first, first), file_name("harbour", 3, first), flags=3),
        slot(standard(OLD, OLD, MADE, OLD), file_name("buoy-17.bin", 1, MADE)),
    )
    assert [r.filename for r in rows] == ["tide tables.csv", "harbour", "buoy-17.bin"]
    assert [r.is_directory for r in rows] == [False, True, False]
    assert [r.embedded_record_number for r in rows] == [0, 0, 0]
    assert [r.likely_timestomped for r in rows] == [False, False, True]
    assert rows[2].timestamp_anomalies == ["creation_time", "modification_time", "access_time"]
    assert rows[2].standard_information.creation_time == OLD
    assert rows[2].parent_record_number == 5 and rows[2].is_allocated


def test_unused_slots_leave_no_row_but_count(decode):
    good = slot(file_name("a", 1, MADE))
    assert [r.record_number for r in decode(good, bytes(1024), good)] == [0, 2]


def test_a_slot_that_breaks_the_decoder_is_a_failure_of_its_own(monkeypatch):
    good, bad = slot(file_name("a", 1, MADE)), slot(file_name("poison", 1, MADE))
    names = decoder._name_text

    def broken(content, chars):
        text = names(content, chars)
        if text == "poison":
            raise ZeroDivisionError("poison")
        return text

    monkeypatch.setattr(decoder, "_name_text", broken)
    raws = [good, bad, bytes(1024), good, None]
    batch = pa.RecordBatch.from_pydict({
        "case_id": ["c"] * 5, "source_path": ["f"] * 5, "record_number": list(range(5)),
        "raw": pa.array(raws, pa.binary()),
    })
    rows = [r for part in decoder._decode_batches(iter([batch])) for r in part.to_pylist()]
    assert [(r["record_number"], r["reason"]) for r in rows] == [(0, None), (1, "cannot be decoded: poison"), (3, None)]
    assert rows[2]["names"][0]["name"] == "a"


@pytest.mark.parametrize(
    "raw, reason",
    [
        (slot(signature=b"BAAD"), "marked corrupt by the file system"),
        (slot(signature=b"XXXX"), "unknown signature"),
        (slot(usa_count=0), "the slot ends before its sector numbers do"),
        (slot(usa_offset=1022), "the slot ends before its sector numbers do"),
        (slot()[:-1] + b"!", "sector 2 does not carry the update number"),
        (slot()[:510] + b"!!" + slot()[512:], "sector 1 does not carry the update number"),
        (slot(attribute(0x99, bytes(904)), struct.pack("<II", 0x10, 8), used=1024, first=56 + 24 + 0,
              end=b"")[:1024], None),
    ],
)
def test_failures(decode, raw, reason):
    row = decode(raw)[0]
    assert row.reason == reason


def test_header_cut_off_at_the_end_is_a_failure(decode):
    filler = attribute(0x99, b"", length=1024 - 56 - 8)
    raw = bytearray(slot(filler, used=1024, usa_count=1, end=b""))
    raw[1016:1024] = struct.pack("<II", 0x10, 8)
    row = decode(bytes(raw))[0]
    assert row.reason == "attribute header runs past the record"


def test_sector_tails_are_put_back(decode):
    """A name that covers the end of the first sector reads as written."""
    long_name = "n" * 200
    pad = attribute(0x99, bytes(200))
    row = decode(slot(pad, file_name(long_name, 1, MADE)))[0]
    assert row.filename == long_name


def test_walk_stops_and_skips(decode):
    name = file_name("x", 1, MADE)
    rows = decode(
        slot(name, end=bytes(4)),
        slot(attribute(0x99, b"", length=0), name),
        slot(attribute(0x99, b"", length=5000), name),
        slot(name, used=40),
        slot(standard(OLD, OLD, OLD, OLD, resident=False), name),
        slot(standard(OLD, OLD, OLD, OLD, size=5000), name),
        slot(attribute(0x10, bytes(31)), name),
        slot(attribute(0x30, bytes(65))),
        slot(standard(OLD, OLD, OLD, OLD), standard(MADE, MADE, MADE, MADE, resident=False), name),
    )
    assert [r.reason for r in rows] == [None] * 9
    assert [r.filename for r in rows] == ["x", None, None, None, "x", "x", "x", None, "x"]
    assert [r.standard_information for r in rows] == [None] * 9


def test_names_cut_short_or_undecodable_keep_their_times(decode):
    rows = decode(
        slot(file_name("ab", 1, MADE, chars=9)),
        slot(file_name("", 1, MADE, raw_name=b"\x00\xd8", chars=1)),
    )
    assert [r.filename for r in rows] == ["", ""]
    assert [r.file_name_information.creation_time for r in rows] == [MADE, MADE]


@pytest.mark.parametrize(
    "spaces, best", [((2, 1), 1), ((1, 3), 0), ((3, 1), 1), ((7, 2), 1), ((0, 2), 0), ((1, 1), 0), ((8, 9), 0)]
)
def test_preferred_name(decode, spaces, best):
    row = decode(slot(*[file_name(f"n{i}", s, MADE) for i, s in enumerate(spaces)]))[0]
    assert row.filename == f"n{best}"


def test_tolerance_is_strict_and_unset_times_say_nothing(decode):
    name = file_name("x", 1, MADE)
    edge, past = MADE - SECOND, MADE - SECOND - timedelta(microseconds=1)
    rows = decode(
        slot(standard(edge, past, 0, 2**64 - 1), name),
        slot(standard(OLD, OLD, OLD, OLD), file_name("x", 1, None)),
        slot(standard(OLD, OLD, OLD, OLD)),
    )
    assert rows[0].timestamp_anomalies == ["modification_time"]
    assert rows[0].standard_information.mft_modification_time is None
    assert rows[0].standard_information.access_time is None
    assert [r.likely_timestomped for r in rows] == [True, False, False]


def test_slot_file_scan(spark, tmp_path):
    raws = [slot(file_name(f"n{i}", 1, MADE), number=i) for i in range(5)]
    path = tmp_path / "$MFT"
    path.write_bytes(b"".join(raws) + bytes(100))
    for uri in (str(path), path.as_uri()):
        slots_df = read_slots(spark, [uri], slots_per_partition=2)
        assert slots_df.rdd.getNumPartitions() == 3
        records, failures = case.mft_from_slots(slots_df)
        found = records.orderBy("record_number").collect()
        assert [r.filename for r in found] == [f"n{i}" for i in range(5)]
        assert [r.embedded_record_number for r in found] == list(range(5))
        assert found[0].source_path == str(path) and failures.count() == 0


def test_other_record_sizes(spark, tmp_path):
    path = tmp_path / "mft"
    path.write_bytes(b"".join(
        slot(file_name("big", 1, MADE), record_bytes=4096, usa_count=9, first=72) for _ in range(3)))
    records, failures = case.read_mft(spark, [str(path)], record_bytes=4096)
    assert [r.filename for r in records.collect()] == ["big"] * 3 and failures.count() == 0
