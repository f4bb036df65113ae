"""File-record slots to file records.

The byte work (sector tails, attribute list) has no Spark expression, so it runs in one Arrow step
that treats a whole batch of slots as a byte matrix. What the fields mean (the preferred name,
anomalies, failure split) stays in Spark expressions around that step.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gainsay.functions.mft import TIME_FIELDS, TOLERANCE, preferred_name, record_anomalies
from gainsay.functions.time import EPOCH_OFFSET_MICROS, LAST_FILETIME

# Byte layout of a file record.
SECTOR_BYTES = 512
RECORD, CORRUPT = b"FILE", b"BAAD"
STANDARD_INFORMATION = 0x10
FILE_NAME = 0x30
END_OF_ATTRIBUTES = 0xFFFFFFFF
PARENT_MASK = 0x0000FFFFFFFFFFFF
_PADDING = 128
_SLOTS_AT_ONCE = 4096

_TIMES = "struct<" + ",".join(f"{field}:timestamp" for field in TIME_FIELDS) + ">"
_NAME = f"struct<namespace:int,parent:bigint,times:{_TIMES},name:string>"
_DECODED = (
    "case_id string, source_path string, record_number bigint, reason string, "
    "embedded_record_number bigint, is_directory boolean, is_allocated boolean, "
    f"standard_information {_TIMES}, names array<{_NAME}>"
)
_ARROW_TIME = pa.timestamp("us", tz="UTC")


def decode(slots: DataFrame, tolerance: timedelta = TOLERANCE) -> DataFrame:
    """(case_id, source_path, record_number, raw) slots to file records plus ``reason``.

    Slots that were never in use (all zero) give neither a record nor a failure.
    """
    decoded = slots.select("case_id", "source_path", "record_number", "raw").mapInArrow(
        _decode_batches, _DECODED
    )
    return (
        decoded.withColumn("_best", preferred_name(F.col("names")))
        .select(
            "case_id",
            "source_path",
            "record_number",
            "embedded_record_number",
            F.col("_best.name").alias("filename"),
            F.col("_best.parent").alias("parent_record_number"),
            "is_directory",
            "is_allocated",
            "standard_information",
            F.col("_best.times").alias("file_name_information"),
            "reason",
        )
        .withColumn(
            "timestamp_anomalies",
            record_anomalies(
                F.col("standard_information"), F.col("file_name_information"), tolerance
            ),
        )
        .withColumn("likely_timestomped", F.size("timestamp_anomalies") > 0)
    )


def slot_mismatches(records: DataFrame) -> DataFrame:
    """Records that carry another number than their place in the file."""
    return records.filter(F.col("embedded_record_number") != F.col("record_number"))


class _Slots:
    """A batch of slots as a zero-padded byte matrix with little-endian reads."""

    def __init__(self, raw: pa.Array):
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]
        content = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
        self.size = np.diff(offsets).astype(np.int64)
        width = int(self.size.max(initial=0))
        self.bytes = np.zeros((len(raw), width + _PADDING), dtype=np.uint8)
        if len(raw) and (self.size == width).all():
            self.bytes[:, :width] = content[offsets[0] : offsets[-1]].reshape(len(raw), width)
        else:
            inside = np.arange(width) < self.size[:, None]
            self.bytes[:, :width][inside] = content[offsets[0] : offsets[-1]]

    def at(self, rows: np.ndarray, offset: np.ndarray | int, count: int) -> np.ndarray:
        """``count`` bytes per row from ``offset``; bytes past the slot read as zero."""
        places = np.asarray(offset, dtype=np.int64).reshape(-1, 1) + np.arange(count)
        last = self.bytes.shape[1] - 1
        return self.bytes[rows.reshape(-1, 1), np.minimum(places, last)]

    def number(self, rows: np.ndarray, offset: np.ndarray | int, count: int) -> np.ndarray:
        weights = np.left_shift(np.uint64(1), np.arange(count, dtype=np.uint64) * np.uint64(8))
        return (self.at(rows, offset, count).astype(np.uint64) * weights).sum(
            axis=1, dtype=np.uint64
        )

    def small(self, rows: np.ndarray, offset: np.ndarray | int, count: int) -> np.ndarray:
        return self.number(rows, offset, count).astype(np.int64)


def _restore_sector_tails(slots: _Slots, reasons: np.ndarray) -> None:
    """Check each sector's last two bytes against the update number and put the real ones back."""
    rows = np.flatnonzero(reasons == None)  # noqa: E711 - element-wise
    start, count = slots.small(rows, 4, 2), slots.small(rows, 6, 2)
    short = (count < 1) | (start + 2 * count > slots.size[rows])
    reasons[rows[short]] = "the slot ends before its sector numbers do"
    rows, start, count = rows[~short], start[~short], count[~short]
    original = slots.bytes.copy()
    for sector in range(1, int(slots.size.max(initial=0)) // SECTOR_BYTES + 1):
        end = sector * SECTOR_BYTES
        covered = (sector < count) & (end <= slots.size[rows])
        here, begin = rows[covered], start[covered].reshape(-1, 1)
        expected = original[here.reshape(-1, 1), begin + np.arange(2)]
        bad = (slots.bytes[here, end - 2 : end] != expected).any(axis=1)
        reasons[here[bad]] = f"sector {sector} does not carry the update number"
        fine = here[~bad]
        slots.bytes[fine, end - 2 : end] = original[
            fine.reshape(-1, 1), begin[~bad] + 2 * sector + np.arange(2)
        ]
        alive = ~np.isin(rows, here[bad])
        rows, start, count = rows[alive], start[alive], count[alive]


def _content(slots: _Slots, rows: np.ndarray, offset: np.ndarray, least: int):
    """Start and length of resident attribute contents of at least ``least`` bytes."""
    length = slots.small(rows, offset + 16, 4)
    start = offset + slots.small(rows, offset + 20, 2)
    resident = slots.small(rows, offset + 8, 1) == 0
    usable = resident & (start + length <= slots.size[rows]) & (length >= least)
    return usable, start, length


def _ticks(slots: _Slots, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Four tick counts per row."""
    return np.stack([slots.number(rows, start + 8 * k, 8) for k in range(4)], axis=1)


def _name_text(content: bytes, chars: int) -> str:
    if 2 * chars > len(content):
        return ""
    try:
        return content[: 2 * chars].decode("utf-16-le")
    except UnicodeDecodeError:
        return ""


def _walk_attributes(slots: _Slots, reasons: np.ndarray):
    """Standard times (the last attribute counts, even unreadable) and every file name."""
    total = len(reasons)
    standard, has_standard = np.zeros((total, 4), dtype=np.uint64), np.zeros(total, dtype=bool)
    names: list[tuple[np.ndarray, ...]] = []
    rows = np.flatnonzero(reasons == None)  # noqa: E711 - element-wise
    offset, end = slots.small(rows, 20, 2), np.minimum(slots.small(rows, 24, 4), slots.size[rows])
    while len(rows):
        kind, length = slots.small(rows, offset, 4), slots.small(rows, offset + 4, 4)
        going = (
            (offset + 4 <= end)
            & (kind != END_OF_ATTRIBUTES)
            & (kind != 0)
            & (offset + 8 <= slots.size[rows])
            & (length != 0)
            & (offset + length <= slots.size[rows])
        )
        rows, offset, end, kind, length = (a[going] for a in (rows, offset, end, kind, length))
        wanted = np.isin(kind, (STANDARD_INFORMATION, FILE_NAME))
        cut_off = wanted & (offset + 8 >= slots.size[rows])
        reasons[rows[cut_off]] = "attribute header runs past the record"

        here = (kind == STANDARD_INFORMATION) & ~cut_off
        usable, start, _ = _content(slots, rows[here], offset[here], 32)
        has_standard[rows[here]] = usable
        standard[rows[here][usable]] = _ticks(slots, rows[here][usable], start[usable])

        here = (kind == FILE_NAME) & ~cut_off
        usable, start, size = _content(slots, rows[here], offset[here], 66)
        named, start, size = rows[here][usable], start[usable], size[usable]
        if len(named):
            texts = [
                _name_text(slots.bytes[r, s + 66 : s + n].tobytes(), int(slots.bytes[r, s + 64]))
                for r, s, n in zip(named, start, size)
            ]
            names.append(
                (
                    named,
                    slots.small(named, start + 65, 1),
                    (slots.number(named, start, 8) & np.uint64(PARENT_MASK)).astype(np.int64),
                    _ticks(slots, named, start + 8),
                    np.array(texts, dtype=object),
                )
            )
        rows, offset, end = (a[~cut_off] for a in (rows, offset + length, end))
    return standard, has_standard, names


def _times(ticks: np.ndarray, valid: np.ndarray | None = None) -> pa.StructArray:
    """Ticks to timestamps. Zero means not set, later than year 9999 is unusable: both are NULL."""
    unset = (ticks == 0) | (ticks > LAST_FILETIME)
    instants = np.where(unset, 0, ticks // np.uint64(10)).astype(np.int64) - EPOCH_OFFSET_MICROS
    return pa.StructArray.from_arrays(
        [pa.array(instants[:, k], _ARROW_TIME, mask=unset[:, k]) for k in range(4)],
        names=list(TIME_FIELDS),
        mask=None if valid is None else pa.array(~valid),
    )


def _names_array(total: int, names: list[tuple[np.ndarray, ...]]) -> pa.ListArray:
    """File names grouped by slot, in the order they were met."""
    if not names:
        names = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros((0, 4), np.uint64),
                  np.zeros(0, object))]
    owner, namespace, parent, ticks, text = (np.concatenate(part) for part in zip(*names))
    order = np.argsort(owner, kind="stable")
    items = pa.StructArray.from_arrays(
        [
            pa.array(namespace[order], pa.int32()),
            pa.array(parent[order], pa.int64()),
            _times(ticks[order]),
            pa.array(text[order], pa.string()),
        ],
        names=["namespace", "parent", "times", "name"],
    )
    ends = np.cumsum(np.bincount(owner, minlength=total))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), items)


def _signatures(slots: _Slots) -> np.ndarray:
    """Reasons by signature; None where the slot may be read on."""
    found = slots.bytes[:, :4]
    reasons = np.full(len(found), "unknown signature", dtype=object)
    reasons[(found == np.frombuffer(CORRUPT, np.uint8)).all(axis=1)] = "marked corrupt by the file system"
    reasons[(found == np.frombuffer(RECORD, np.uint8)).all(axis=1)] = None
    return reasons


_COLUMNS = [
    "case_id", "source_path", "record_number", "reason", "embedded_record_number",
    "is_directory", "is_allocated", "standard_information", "names",
]


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(batch.column("raw").is_valid())
        for first in range(0, batch.num_rows, _SLOTS_AT_ONCE):
            yield from _guarded(batch.slice(first, _SLOTS_AT_ONCE))


def _guarded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The decoded batch. Where that fails for a reason of its own, each slot alone; the bad one is a failure."""
    try:
        yield _decoded(batch)
    except Exception as error:  # noqa: BLE001 - one slot must not end the job
        if batch.num_rows > 1:
            for row in range(batch.num_rows):
                yield from _guarded(batch.slice(row, 1))
        else:
            empty = _decoded(batch.slice(0, 0))
            values = [batch.column(i) for i in range(3)] + [pa.array([f"cannot be decoded: {error}"], pa.string())]
            values += [pa.nulls(1, empty.column(i).type) for i in range(4, len(_COLUMNS))]
            yield pa.RecordBatch.from_arrays(values, names=_COLUMNS)


def _decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
    slots = _Slots(batch.column("raw"))
    used = slots.bytes.any(axis=1)
    if not used.all():
        batch = batch.filter(pa.array(used))
        slots.bytes, slots.size = slots.bytes[used], slots.size[used]
    reasons = _signatures(slots)
    _restore_sector_tails(slots, reasons)
    every = np.arange(len(reasons))
    flags = slots.small(every, 22, 2)
    embedded = slots.small(every, 44, 4)
    standard, has_standard, names = _walk_attributes(slots, reasons)
    usable = reasons == None  # noqa: E711 - element-wise
    return pa.RecordBatch.from_arrays(
        [
            batch.column("case_id"),
            batch.column("source_path"),
            batch.column("record_number"),
            pa.array(reasons.tolist(), pa.string()),
            pa.array(embedded, mask=~(usable & (slots.size >= 48))),
            pa.array((flags & 2) != 0, mask=~usable),
            pa.array((flags & 1) != 0, mask=~usable),
            _times(standard, has_standard & usable),
            _names_array(len(reasons), names),
        ],
        names=_COLUMNS,
    )
