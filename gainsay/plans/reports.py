"""Listings, summaries and report rows, and the sinks that write them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from gainsay.functions.registry import value_label, value_text
from gainsay.functions.text import basename, html_escape, iso_timestamp
from gainsay.session import checkpointed, use_checkpoint_dir
from gainsay.sources.files import open_uri
from gainsay.sources.report_files import COLUMNS, LISTED, ReportFiles

# Columns of the event report, in order.
EVENT_REPORT_COLUMNS = (
    "record_number", "event_id", "timestamp", "provider_name", "computer_name", "channel",
    "level", "message",
)


# --- event reports -----------------------------------------------------------------------------


def event_row_html(columns: Sequence[str] = EVENT_REPORT_COLUMNS) -> Column:
    """One event as a table row: a cell per column, blank for NULL, and the level as data of the row."""
    texts = [
        iso_timestamp(F.col(c)) if c == "timestamp" else F.col(c).cast("string") for c in columns
    ]
    cells = F.array_join(
        F.transform(F.array(*texts), lambda t: F.concat(F.lit("<td>"), F.coalesce(html_escape(t), F.lit("")))),
        "</td>",
    )
    level = F.coalesce(F.concat(F.lit(' data-level="'), F.col("level").cast("string"), F.lit('"')), F.lit(""))
    return F.concat(F.lit("<tr"), level, F.lit(">"), cells, F.lit("</td></tr>"))


def failure_row_html() -> Column:
    """One failed record as a table row."""
    number = F.coalesce(F.col("record_number").cast("string"), F.lit(""))
    return F.concat(
        F.lit("<tr data-failed><td>"), number, F.lit("</td><td>"), html_escape(F.col("reason")), F.lit("</td></tr>")
    )


def event_report(events: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Report rows per source: ``section`` records come before failures, records in number order."""
    rows = events.select(
        "case_id", "source_path", F.lit("1-records").alias("section"),
        F.col("record_number").alias("place"), event_row_html().alias("value"),
    )
    if failures is None:
        return rows
    return rows.unionByName(
        failures.select(
            "case_id", "source_path", F.lit("2-failures").alias("section"),
            F.col("record_number").alias("place"), failure_row_html().alias("value"),
        )
    )


def event_report_totals(events: DataFrame) -> DataFrame:
    """Number of files and records of a combined report."""
    return events.agg(
        F.count_distinct("case_id", "source_path").alias("file_count"),
        F.count(F.lit(1)).alias("record_count"),
    )


def write_event_report(report: DataFrame, path: str) -> None:
    """One folder per case, source and section; part files follow the record order."""
    keys = ["case_id", "source_path", "section"]
    (
        report.repartitionByRange(*keys, "place")
        .sortWithinPartitions(*keys, "place")
        .select(*keys, "value")
        .write.partitionBy(*keys)
        .mode("overwrite")
        .text(path)
    )


# Records whose numbers agree but for this many low bits are never dealt to different tasks.
_TOGETHER_BITS = 20


def write_report_files(report: DataFrame, path: str, mode: str = "overwrite", whole: bool = False) -> None:
    """One file per case and source, ``case=<case>/report=<source>.00000.html``: records by number, then failures.

    All files appear when the whole report is written, or none. A source whose numbers span over 2**20 may go on in
    files with the numbers 00001 and up, so that one huge log does not have to pass through one task. With ``whole``
    every source is one file however long: such parts are sorted and written by many tasks to the checkpoint folder,
    then a task per source copies their bytes one after the other.
    """
    keys = ["case_id", "source_path", "section"]
    report.sparkSession.dataSource.register(ReportFiles)
    lines = (
        report.repartitionByRange(*keys, F.shiftright(F.coalesce(F.col("place").cast("bigint"), F.lit(-1)), _TOGETHER_BITS))
        .sortWithinPartitions(*keys, "place", "value")
        .select(*[F.col(c).cast("string").alias(c) for c in COLUMNS])
    )
    if whole:
        _write_joined(lines, path, mode)
    else:
        lines.write.format("report_files").mode(mode).save(path)


def _write_joined(lines: DataFrame, path: str, mode: str) -> None:
    spark = lines.sparkSession
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    listing = f"{folder}/files.json"
    try:
        lines.write.format("report_files").option("listing", listing).mode("overwrite").save(folder)
        # The rows are names of files, few and of much work each: as many tasks as there are cores.
        (
            spark.read.schema(LISTED).json(listing)
            .repartition(max(spark.sparkContext.defaultParallelism, 1), "case_id", "source_path")
            .sortWithinPartitions("case_id", "source_path", "place")
            .select("case_id", "source_path", F.col("file").alias("value"))
            .write.format("report_files").option("joined", folder).mode(mode).save(path)
        )
    finally:
        store, pieces = open_uri(folder)
        if store.get_file_info(pieces).type == fs.FileType.Directory:
            store.delete_dir(pieces)


# --- findings ----------------------------------------------------------------------------------


def finding_row_html() -> Column:
    """One finding as a table row: rule, description, evidence as a list, sources."""
    points = F.transform("evidence", lambda x: F.concat(F.lit("<li>"), html_escape(x), F.lit("</li>")))
    return F.concat(
        F.lit('<tr data-severity="'), "severity", F.lit('"><th>'), html_escape(F.col("rule_name")),
        F.lit("</th><td>"), html_escape(F.col("description")), F.lit("</td><td><ul>"),
        F.array_join(points, ""), F.lit("</ul></td><td>"),
        F.array_join(F.transform("source_paths", html_escape), ", "), F.lit("</td></tr>"),
    )


NOTHING_FOUND = '<tr data-severity="none"><td>nothing was found</td></tr>'


def findings_report(found: DataFrame) -> DataFrame:
    """Report rows of findings; a single row that says so when there are none.

    Whether there are any is only known when they have been found, so the rows are written out once.
    """
    rows = checkpointed(found.select(finding_row_html().alias("value")))
    none = (
        rows.agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == 0)
        .select(F.lit(NOTHING_FOUND).alias("value"))
    )
    return rows.unionByName(none)


def finding_detail() -> Column:
    """One finding as plain text."""
    points = F.transform("evidence", lambda x: F.concat(F.lit("* "), x))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_name"),
        F.col("description"),
        F.array_join(points, "\n"),
        F.concat(F.lit("in "), F.array_join("source_paths", ", ")),
    )


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("finding_count"))


def write_findings(found: DataFrame, path: str, format: str = "parquet") -> None:
    """Findings as parquet, ORC, JSON or CSV; CSV has no lists, so those become lines of text."""
    if format == "csv":
        found = found.withColumns(
            {c: F.array_join(c, "\n") for c in ("evidence", "source_paths")}
        )
    writer = found.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.options(header="true", escape='"')
    writer.save(path)


# --- summaries and listings --------------------------------------------------------------------


def source_summary(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], sample: Sequence[str]
) -> DataFrame:
    """Rows per source and the fields of its first row."""
    first = F.min_by(F.struct(*sample), F.struct(*order))
    return (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("record_count"), first.alias("_first"))
        .select(*by, "record_count", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in sample])
    )


def event_source_summary(events: DataFrame) -> DataFrame:
    return source_summary(
        events,
        ["case_id", "source_path"],
        ["record_number"],
        ["record_number", "event_id", "timestamp", "provider_name"],
    )


def prefetch_lines(records: DataFrame) -> DataFrame:
    return records.select(
        "case_id", basename(F.col("source_path")).alias("file_name"), "executable_name", "run_count"
    )


def prefetch_summary(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.col("filename_hash_matches") == F.lit(False)).alias("mismatch_count"),
    )


def mft_summary(records: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Records by kind, flagged records and failures in one row."""
    flags = {
        "timestomped_count": F.col("likely_timestomped"),
        "directory_count": F.col("is_directory"),
        "deleted_count": ~F.col("is_allocated"),
    }
    rows = records.select(F.lit(False).alias("failed"), *[c.alias(n) for n, c in flags.items()])
    totals = [F.count_if(~F.col("failed")).alias("record_count"), *[F.count_if(n).alias(n) for n in flags]]
    if failures is None:
        return rows.agg(*totals)
    letters = failures.select(F.lit(True).alias("failed"), *[F.lit(None).cast("boolean").alias(n) for n in flags])
    return rows.unionByName(letters).agg(*totals, F.count_if("failed").alias("failure_count"))


def timestomped(records: DataFrame) -> DataFrame:
    return records.filter("likely_timestomped").select(
        "case_id", "source_path", "record_number", "filename",
        F.array_join("timestamp_anomalies", ", ").alias("anomalies"),
    )


def value_listing(values: DataFrame) -> DataFrame:
    return values.select(
        "case_id", "source_path", "key_path", value_label(F.col("name")).alias("name"),
        "value_type_str", value_text(F.col("data")).alias("data"),
    )


def event_listing(events: DataFrame) -> DataFrame:
    return events.select(
        "record_number", "event_id", "timestamp", "provider_name", "channel", "level", "computer_name"
    )


def prefetch_listing(records: DataFrame) -> DataFrame:
    """One row per run time; a record without any keeps one row."""
    return records.select(
        "case_id", "source_path", "executable_name", "prefetch_hash", "filename_hash_matches",
        "format_version", "run_count", F.size("referenced_filenames").alias("filename_count"),
        F.posexplode_outer("last_run_times").alias("run_index", "run_time"),
    )


def prefetch_volumes(records: DataFrame) -> DataFrame:
    """One row per volume; a record without any keeps one row."""
    return records.select("case_id", "source_path", F.explode_outer("volumes").alias("volume")).select(
        "case_id", "source_path", "volume.*"
    )
