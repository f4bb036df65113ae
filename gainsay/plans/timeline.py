"""One ordered stream of everything that has a time in a case, and file times beside other artifacts' times."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gainsay.operators.order import in_sessions, nearest
from gainsay.session import use_checkpoint_dir
from gainsay.sources.case import CaseTables

IDLE = timedelta(minutes=30)
FILE_TIMES = ("creation_time", "modification_time", "mft_modification_time", "access_time")
# Columns that order entries of one case and time.
_THEN = ("kind", "source_path", "number", "label")


def entries(tables: CaseTables) -> DataFrame:
    """``case_id``, ``at``, ``kind``, ``source_path``, ``number`` and ``label`` of every time that an artifact records.

    Kinds are "event", "run" (a run time of a prefetch record) and the names of file times, of the standard
    information with the prefix "file " and of the file name with "name ". Times that are not set have no entry.
    """
    events = _entries(tables.events, F.col("timestamp"), F.lit("event"), F.col("record_number"), F.col("provider_name"))
    runs = tables.prefetch.select(
        "case_id", "source_path", "executable_name", F.posexplode("last_run_times").alias("place", "at")
    )
    parts = [events, _entries(runs, F.col("at"), F.lit("run"), F.col("place"), F.col("executable_name"))]
    # All times of a record in one pass: the records may be dear to make.
    times = F.array(*[
        F.struct(F.lit(prefix + t).alias("kind"), F.col(column)[t].alias("at"))
        for prefix, column in (("file ", "standard_information"), ("name ", "file_name_information")) for t in FILE_TIMES
    ])
    files = tables.mft.select("case_id", "source_path", "record_number", "filename", F.inline(times))
    parts.append(_entries(files, F.col("at"), F.col("kind"), F.col("record_number"), F.col("filename")))
    return reduce(DataFrame.unionByName, parts)


def _entries(rows: DataFrame, at: Column, kind: Column, number: Column, label: Column) -> DataFrame:
    return rows.select(
        "case_id", at.alias("at"), kind.alias("kind"), "source_path", number.cast("bigint").alias("number"), label.alias("label")
    ).filter(F.col("at").isNotNull())


def timeline(tables: CaseTables, idle: timedelta = IDLE) -> DataFrame:
    """All entries by case and time, with their position and session over all cases.

    A session is a run of entries of one case without a pause longer than ``idle``. Entries of one time come
    by kind, source, number and label. A case of any size, and any burst at one time, is spread over many tasks.
    Counting and dealing read the entries three times, so they are written to the checkpoint folder first.
    """
    spark = tables.events.sparkSession
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/entries-{uuid.uuid4().hex}"
    found = entries(tables)
    found.write.parquet(folder)
    return in_sessions(spark.read.schema(found.schema).parquet(folder), by=["case_id"], time="at", idle=idle, then=_THEN)


def nearest_events(tables: CaseTables, time: str = "creation_time", within: timedelta | None = None) -> DataFrame:
    """Every file record with the event of its case that is nearest to one of its standard times.

    ``nearest`` has the event's time, how much later it is than the file's, its log and its record number; null
    where the case has no event (``within`` that distance) or the file no such time.
    """
    files = tables.mft.select(
        "case_id", "source_path", "record_number", "filename", F.col("standard_information")[time].alias("file_time")
    )
    events = tables.events.select("case_id", "timestamp", F.col("record_number").alias("event_number"), F.col("source_path").alias("log"))
    return nearest(
        files, events, by=["case_id"], left_time="file_time", right_time="timestamp", take=["event_number", "log"], within=within
    )
