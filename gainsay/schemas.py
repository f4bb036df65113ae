"""Table schemas of one or many cases. All timestamps are UTC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STRING, LONG, INT, BOOL = StringType(), LongType(), IntegerType(), BooleanType()
BYTES, TIME = BinaryType(), TimestampType()
STRINGS, TIMES = ArrayType(STRING), ArrayType(TIME)


def struct(*required: str, **fields: DataType) -> StructType:
    """Fields in the given order; those named in ``required`` are not nullable."""
    return StructType([StructField(n, t, n not in required) for n, t in fields.items()])


def _table(*required: str, **fields: DataType) -> StructType:
    keys = {"case_id": STRING, "source_path": STRING}
    return struct(*keys, *required, **keys, **fields)


EVENTS = _table(
    "record_number",
    "raw_xml",
    record_number=LONG,
    event_id=LONG,
    timestamp=TIME,
    provider_name=STRING,
    computer_name=STRING,
    channel=STRING,
    level=LONG,
    message=STRING,
    raw_xml=STRING,
)
EVENT_XML = _table(record_number=LONG, raw_xml=STRING)

REGISTRY_CELLS = _table(
    "key_id", key_id=LONG, parent_id=LONG, name=STRING, last_written=TIME, reason=STRING
)
REGISTRY_KEYS = _table(
    path=STRING, name=STRING, last_written=TIME, subkey_count=LONG, value_count=LONG
)
# Exactly one of s, i, b and l holds the data; kind says which.
VALUE_DATA = struct(kind=STRING, s=STRING, i=LONG, b=BYTES, l=STRINGS)
REGISTRY_VALUES = _table(
    key_path=STRING,
    name=STRING,
    value_type=LONG,
    value_type_str=STRING,
    data=VALUE_DATA,
    raw_data=STRING,
    raw_data_bytes=BYTES,
)

PREFETCH_RAW = _table(
    executable_filename=STRING,
    prefetch_hash=LONG,
    format_version=INT,
    run_count=LONG,
    last_run_times=TIMES,
    filenames=STRINGS,
    volumes=ArrayType(struct(device_path=STRING, serial_number=LONG, creation_time=TIME)),
)
VOLUMES = ArrayType(struct(device_path=STRING, serial_number=STRING, creation_time=TIME))
FIELD_FAILURES = ArrayType(struct(field_group=STRING, reason=STRING))
PREFETCH = _table(
    executable_name=STRING,
    prefetch_hash=STRING,
    filename_hash_matches=BOOL,
    format_version=INT,
    run_count=LONG,
    last_run_times=TIMES,
    referenced_filenames=STRINGS,
    volumes=VOLUMES,
)

MFT_SLOTS = _table("record_number", record_number=LONG, raw=BYTES)
FOUR_TIMES = struct(
    creation_time=TIME, modification_time=TIME, mft_modification_time=TIME, access_time=TIME
)
MFT = _table(
    "record_number",
    record_number=LONG,
    embedded_record_number=LONG,
    filename=STRING,
    parent_record_number=LONG,
    is_directory=BOOL,
    is_allocated=BOOL,
    standard_information=FOUR_TIMES,
    file_name_information=FOUR_TIMES,
    timestamp_anomalies=STRINGS,
    likely_timestomped=BOOL,
)

BAD_FILES = _table(reason=STRING)
# Dead letters of all stages; place says which record, key or field of the file failed.
FAILURES = _table(stage=STRING, place=STRING, reason=STRING)

FINDINGS = struct(
    case_id=STRING,
    rule_name=STRING,
    severity=STRING,
    severity_rank=INT,
    rule_ordinal=INT,
    ordinal=LONG,
    description=STRING,
    evidence=STRINGS,
    source_paths=STRINGS,
    details=STRING,
)

# Severity levels, low to high.
SEVERITIES = ("info", "low", "medium", "high")


def severity_rank(severity: Column) -> Column:
    return reduce(
        lambda chain, level: chain.when(severity == level[1], level[0]),
        list(enumerate(SEVERITIES))[1:],
        F.when(severity == SEVERITIES[0], 0),
    ).cast("int")
