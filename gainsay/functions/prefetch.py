"""Prefetch field extraction. Every field fails on its own; a bad field never drops the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gainsay.functions.text import basename
from gainsay.functions.time import utc
from gainsay.schemas import FIELD_FAILURES, VOLUMES

MAX_RUN_TIMES = 8

# Fixed value: NAME-HHHHHHHH.pf, the extension in lower case only.
PF_NAME_PATTERN = r"^(.+)-([0-9A-Fa-f]{8})\.pf$"


def hash_hex(value: Column) -> Column:
    """Unsigned 32-bit number as eight upper-case hex digits."""
    return F.when(value.between(0, 0xFFFFFFFF), F.lpad(F.hex(value), 8, "0"))


def run_times(times: Column) -> Column:
    """At most eight run times, cut at the first missing slot."""
    slots = F.transform(F.slice(times, 1, MAX_RUN_TIMES), utc)
    first_gap = F.array_position(F.transform(slots, lambda t: t.isNull()), True)
    kept = F.when(first_gap == 0, slots).otherwise(
        F.slice(slots, F.lit(1), F.greatest(first_gap.cast("int") - 1, F.lit(0)))
    )
    return F.coalesce(kept, F.array().cast("array<timestamp>"))


def referenced_filenames(names: Column) -> Column:
    return F.coalesce(F.array_compact(names), F.array().cast("array<string>"))


def volumes(raw: Column) -> Column:
    model = F.transform(
        F.array_compact(raw),
        lambda v: F.struct(
            v["device_path"].alias("device_path"),
            hash_hex(v["serial_number"]).alias("serial_number"),
            utc(v["creation_time"]).alias("creation_time"),
        ),
    )
    return F.coalesce(model, F.array().cast(VOLUMES))


def filename_hash_matches(source_path: Column, embedded: Column) -> Column:
    """TRUE, FALSE, or NULL when there is nothing to compare."""
    in_name = F.nullif(F.regexp_extract(basename(source_path), PF_NAME_PATTERN, 2), F.lit(""))
    return F.upper(in_name) == F.upper(embedded)


def _failure(bad: Column, field_group: str, reason: str) -> Column:
    return F.when(
        bad, F.struct(F.lit(field_group).alias("field_group"), F.lit(reason).alias("reason"))
    )


def decode(raw: DataFrame) -> DataFrame:
    """Landing rows to prefetch records plus a ``field_failures`` array.

    Numbers may arrive as text; text that is no number, and a number out of range, null that field only. A decoder can hand
    over its own failures in a ``field_errors`` column.
    """
    def number(name: str, to: str) -> tuple[Column, Column]:
        value = F.col(name).try_cast(to)
        return value, F.col(name).isNotNull() & value.isNull()

    hash_value, hash_bad = number("prefetch_hash", "bigint")
    version, version_bad = number("format_version", "int")
    count, count_bad = number("run_count", "bigint")
    embedded = hash_hex(hash_value)
    failures = F.array_compact(
        F.array(
            _failure(hash_bad | ~hash_value.between(0, 0xFFFFFFFF), "prefetch_hash", "not a 32-bit number"),
            _failure(version_bad, "format_version", "not a number"),
            _failure(count_bad, "run_count", "not a number"),
        )
    )
    if "field_errors" in raw.columns:
        failures = F.concat(failures, F.coalesce("field_errors", F.array().cast(FIELD_FAILURES)))
    return raw.select(
        "case_id",
        "source_path",
        F.col("executable_filename").alias("executable_name"),
        embedded.alias("prefetch_hash"),
        filename_hash_matches(F.col("source_path"), embedded).alias("filename_hash_matches"),
        version.alias("format_version"),
        count.alias("run_count"),
        run_times(F.col("last_run_times")).alias("last_run_times"),
        referenced_filenames(F.col("filenames")).alias("referenced_filenames"),
        volumes(F.col("volumes")).alias("volumes"),
        failures.alias("field_failures"),
    )


def field_failures(decoded: DataFrame) -> DataFrame:
    """One dead-letter row per unreadable field."""
    return decoded.select("case_id", "source_path", F.inline("field_failures"))


def explode_run_times(records: DataFrame) -> DataFrame:
    """One row per (record, run time); repeated times stay, an empty list gives no row."""
    rest = [c for c in records.columns if c != "last_run_times"]
    return records.select(*rest, F.posexplode("last_run_times").alias("run_index", "run_time"))
