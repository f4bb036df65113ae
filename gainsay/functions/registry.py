"""Registry field extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gainsay.functions.time import utc

# Key-path segments that mark a run-at-startup location.
PERSISTENCE_SEGMENTS = ("run", "runonce", "runservices", "runservicesonce")

# Fixed value: a file name ending in .exe, without path, space or quote characters.
EXE_PATTERN = r'(?iU)([^\\/\s"]+\.exe)'


def is_persistence_key(
    key_path: Column, segments: Sequence[str] = PERSISTENCE_SEGMENTS
) -> Column:
    """True when a whole backslash-separated segment is one of ``segments``, in any case."""
    wanted = F.array(*[F.lit(segment.lower()) for segment in segments]).cast("array<string>")
    return F.arrays_overlap(F.split(F.lower(key_path), r"\\"), wanted)


def exe_reference(text: Column) -> Column:
    """First ``something.exe`` in a command line, or NULL."""
    return F.nullif(F.regexp_extract(text, EXE_PATTERN, 1), F.lit(""))


def value_label(name: Column) -> Column:
    """Display name of a value; the nameless one is the key's default."""
    return F.when(F.coalesce(name, F.lit("")) == "", "(default)").otherwise(name)


def value_text(data: Column) -> Column:
    """Typed value data as JSON text; only the member that holds the data is shown."""
    return F.to_json(data)


def raw_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def project_values(cells: DataFrame) -> DataFrame:
    """Landing rows of values to the value table; rows that carry a ``reason`` are failures."""
    reason = F.col("reason") if "reason" in cells.columns else F.lit(None).cast("string")
    return cells.select(
        "case_id",
        "source_path",
        "key_path",
        F.coalesce("name", F.lit("")).alias("name"),
        "value_type",
        "value_type_str",
        "data",
        raw_hex(F.col("raw_data_bytes")).alias("raw_data"),
        "raw_data_bytes",
        reason.alias("reason"),
    )


def explode_values(keys: DataFrame, values: str = "values") -> DataFrame:
    """One row per value of each key; a key whose values could not be listed keeps one failure row."""
    failed = F.col("values_error") if "values_error" in keys.columns else F.lit(None).cast("string")
    rest = [c for c in keys.columns if c not in (values, "values_error")]
    rows = keys.select(*rest, failed.alias("reason"), F.explode_outer(values).alias("value"))
    return rows.filter(F.col("value").isNotNull() | F.col("reason").isNotNull())


def project_keys(keys: DataFrame) -> DataFrame:
    return keys.select(
        "case_id",
        "source_path",
        "path",
        "name",
        utc(F.col("last_written")).alias("last_written"),
        F.col("subkey_count").cast("bigint").alias("subkey_count"),
        F.col("value_count").cast("bigint").alias("value_count"),
    )


def under_key(path: Column, root: str) -> Column:
    """True for ``root`` itself and everything below it, in any case."""
    folded = root.lower().rstrip("\\")
    lowered = F.lower(path)
    return (lowered == folded) | F.startswith(lowered, F.lit(folded + "\\"))
