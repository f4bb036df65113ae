"""Row-level failure handling and per-case gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

CASE = ("case_id",)


def split_failures(
    decoded: DataFrame, keys: Sequence[str] = ("case_id", "source_path", "record_number")
) -> tuple[DataFrame, DataFrame]:
    """Split a decoded frame into usable records and dead-letter rows (keys + reason)."""
    good = decoded.filter(F.col("reason").isNull()).drop("reason")
    bad = decoded.filter(F.col("reason").isNotNull()).select(*keys, "reason")
    return good, bad


def only_cases_with(rows: DataFrame, other: DataFrame, by: Sequence[str] = CASE) -> DataFrame:
    """Keep rows whose case has at least one row in ``other``.

    Without this gate, "nothing was loaded to compare with" would read as "compared, not found".
    Only the keys of ``other`` are read and they are combined before the shuffle.
    """
    return rows.join(other.select(*by).distinct(), list(by), "left_semi")


def without_bad_files(
    records: DataFrame, bad_files: DataFrame, by: Sequence[str] = ("case_id", "source_path")
) -> DataFrame:
    """Drop every row of a file whose read failed at any point."""
    return records.join(bad_files.select(*by).distinct(), list(by), "left_anti")


def not_seen(
    rows: DataFrame,
    seen: DataFrame,
    by: Sequence[str],
) -> DataFrame:
    """Rows whose key does not occur in ``seen``. NULL keys are never seen."""
    return rows.join(seen.select(*by).distinct(), list(by), "left_anti")

