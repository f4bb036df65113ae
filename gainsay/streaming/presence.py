"""Runs without an event that names them, while both are still being written.

Events become mentions of the names on a watch list, as in the batch rule, and mentions shrink to the first and
last time per case, name and time bucket as wide as the window: these two decide every run exactly, and a burst of
any size is one row. A bucket comes out when the watermark has passed its end and meets the runs in a stream-stream
left outer join on case, name and bucket, at most three rows a run. Watermarks on both sides let go of
everything that no later row can meet, so the state holds a few windows' worth of buckets and runs and no more; a run
without a mention comes out once the watermark has passed the buckets around it. Only rows that pass the plan's
filters (a listed name, a key, a text) move the watermark.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from gainsay.functions.time import micros
from gainsay.operators.presence import floor_div, mentions


def live_unmatched(
    runs: DataFrame,
    events: DataFrame,
    names: DataFrame,
    *,
    window: timedelta,
    late: timedelta,
    by: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Runs (``by``, ``name``, ``time``, more columns stay) that no event (``by``, ``text``, ``time``) names within +-``window``.

    ``names`` is the watch list, a table with one column ``name``: runs of other names are not judged and left
    out. Rows may come ``late`` by so much and are dropped when later. Rows without a time or key are left out.
    """
    by = list(by)
    width = max(micros(window), 1)
    listed = names.select(F.lower("name").alias("_name")).filter("_name != ''").distinct()
    left = (
        runs.filter(F.col("time").isNotNull())
        .withWatermark("time", f"{micros(late)} microseconds")
        .withColumns({"_name": F.lower("name"), "_bucket": floor_div(F.unix_micros("time"), width)})
        .join(listed, "_name", "left_semi")
    )
    timed = events.filter(F.col("time").isNotNull()).select(*by, F.col("text").alias("_text"), F.col("time").alias("_at"))
    found = mentions(timed.withWatermark("_at", f"{micros(late)} microseconds"), names, keep=[*by, "_at"], text="_text")
    length = f"{width} microseconds"
    spans = (
        found.groupBy(F.window("_at", length).alias("_window"), *by, "name")
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        .withColumns({"_closed": F.window_time("_window"), "_own": floor_div(F.unix_micros("_window.start"), width)})
    )
    right = spans.withColumn("_bucket", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)))
    same = F.col("l._name") == F.col("r.name")
    for column in (*by, "_bucket"):
        same = same & (F.col(f"l.{column}") == F.col(f"r.{column}"))
    span = F.lit(window)
    near = (F.col("r._last") >= F.col("l.time") - span) & (F.col("r._first") <= F.col("l.time") + span)
    # True of the bucket of a run and those beside it; tells the watermark how long rows are of use.
    one, two = F.lit(timedelta(microseconds=width)), F.lit(timedelta(microseconds=2 * width))
    useful = (F.col("r._closed") >= F.col("l.time") - one) & (F.col("r._closed") <= F.col("l.time") + two)
    return (
        left.alias("l").join(right.alias("r"), same & near & useful, "left_outer")
        .filter(F.col("r._first").isNull())
        .select(*[F.col(f"l.{c}") for c in runs.columns])
    )
