"""Parent-linked rows to full paths.

Every row holds a pointer to the ancestor above the part of its path known so far. A round replaces
each pointer by that ancestor's own pointer and joins the two path parts, so the known part doubles
and the number of rounds is the logarithm of the depth. Rows that have reached their root are written
once and only looked up from then on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gainsay.session import checkpointed


def key_paths(
    cells: DataFrame,
    *,
    by: Sequence[str] = ("case_id", "source_path"),
    key: str = "key_id",
    parent: str = "parent_id",
    name: str = "name",
    separator: str = "\\",
) -> DataFrame:
    """``by``, key, ``names`` (root first), ``path`` and ``depth`` of every reachable row, however deep.

    Rows with a ``reason`` are left out together with everything below them (``key_failures`` lists
    them), as are rows whose chain of parents ends at a missing row or in a loop. ``names`` sorts in
    depth-first order.
    """
    by = list(by)
    usable = cells.filter(F.col("reason").isNull()) if "reason" in cells.columns else cells
    state = checkpointed(
        usable.select(
            *by,
            F.col(key).alias("_key"),
            F.col(parent).alias("_above"),
            F.array(F.coalesce(F.col(name), F.lit(""))).alias("names"),
        )
    )
    finished = state.filter(F.col("_above").isNull())
    open_rows = state.filter(F.col("_above").isNotNull())
    while True:
        step = checkpointed(_one_round(open_rows, finished, by))
        arrived = step.filter(F.col("_above").isNull())
        # In every round the rows whose root is nearest arrive. Where none does, only loops are left.
        if arrived.isEmpty():
            break
        finished = finished.unionByName(arrived)
        open_rows = step.filter(F.col("_above").isNotNull())
    return finished.select(
        *by,
        F.col("_key").alias(key),
        "names",
        F.array_join("names", separator).alias("path"),
        F.size("names").alias("depth"),
    )


def key_failures(
    cells: DataFrame, by: Sequence[str] = ("case_id", "source_path"), key: str = "key_id"
) -> DataFrame:
    """One dead-letter row per key that could not be read."""
    return cells.filter(F.col("reason").isNotNull()).select(*by, key, "reason")


def _one_round(open_rows: DataFrame, finished: DataFrame, by: list[str]) -> DataFrame:
    """The open rows, each with the known part of its path joined to that of the row it points to."""
    known = finished.unionByName(open_rows)
    above = known.select(
        *by,
        F.col("_key").alias("_above"),
        F.col("_above").alias("_next"),
        F.col("names").alias("_names"),
    )
    return open_rows.join(above, [*by, "_above"]).select(
        *by, "_key", F.col("_next").alias("_above"), F.concat("_names", "names").alias("names")
    )


def with_subkey_counts(
    cells: DataFrame, by: Sequence[str] = ("case_id", "source_path")
) -> DataFrame:
    """Number of direct children per row, for inputs that do not carry it."""
    counts = (
        cells.filter(F.col("parent_id").isNotNull())
        .groupBy(*by, F.col("parent_id").alias("key_id"))
        .agg(F.count(F.lit(1)).alias("subkey_count"))
    )
    return cells.join(counts, [*by, "key_id"], "left").withColumn(
        "subkey_count", F.coalesce("subkey_count", F.lit(0).cast("bigint"))
    )
