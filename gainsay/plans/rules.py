"""The five consistency rules. Each takes the case tables and returns findings.

A finding's ``details`` holds the facts as JSON; description and evidence are rendered from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from gainsay.functions import prefetch, registry
from gainsay.functions.text import basename, iso_timestamp
from gainsay.operators import gaps
from gainsay.operators.presence import unmatched_in_window
from gainsay.operators.rows import not_seen, only_cases_with
from gainsay.schemas import SEVERITIES
from gainsay.session import checkpointed
from gainsay.sources.case import CaseTables

# Ids of events that report a new process.
PROCESS_CREATION_IDS = (1, 4688)
TIME_WINDOW = timedelta(minutes=5)
SIGNIFICANT_GAP = 10
EVIDENCE_LINES = 10

# Names of the rules; their severities are likewise fixed.
PREFETCH_WITHOUT_EVENT = "prefetch_execution_without_evtx"
PERSISTENCE_WITHOUT_EXECUTION = "persistence_without_execution"
HASH_MISMATCH = "prefetch_filename_hash_mismatch"
RECORD_GAP = "evtx_record_number_gap"
TIMESTOMPING = "mft_timestomping_detected"

_SOURCE = ("case_id", "source_path")


def findings(
    rows: DataFrame,
    rule_name: str,
    severity: str,
    *,
    description: Column,
    evidence: Sequence[Column] | Column,
    details: dict[str, Column],
    ordinal: Column,
    source_paths: Column | None = None,
) -> DataFrame:
    """Rows to the findings schema; ``ordinal`` orders findings of one source within the rule."""
    lines = evidence if isinstance(evidence, Column) else F.array(*evidence)
    return rows.select(
        "case_id",
        F.lit(rule_name).alias("rule_name"),
        F.lit(severity).alias("severity"),
        F.lit(SEVERITIES.index(severity)).alias("severity_rank"),
        F.lit(0).alias("rule_ordinal"),
        ordinal.cast("bigint").alias("ordinal"),
        description.alias("description"),
        lines.alias("evidence"),
        (F.array("source_path") if source_paths is None else source_paths).alias("source_paths"),
        F.to_json(F.struct(*[v.alias(k) for k, v in details.items()])).alias("details"),
    )


def process_creations(events: DataFrame, event_ids: Sequence[int] = PROCESS_CREATION_IDS) -> DataFrame:
    return events.filter(F.col("event_id").isin(*event_ids) & F.col("timestamp").isNotNull())


def prefetch_execution_without_event(
    tables: CaseTables,
    time_window: timedelta = TIME_WINDOW,
    process_creation_event_ids: Sequence[int] = PROCESS_CREATION_IDS,
) -> DataFrame:
    """Run times without a process-creation event that names the executable nearby."""
    runs = prefetch.explode_run_times(
        tables.prefetch.filter(F.coalesce("executable_name", F.lit("")) != "").select(
            *_SOURCE, "executable_name", "last_run_times"
        )
    )
    gated = only_cases_with(runs, tables.events)
    unmatched = unmatched_in_window(
        gated,
        process_creations(tables.events, process_creation_event_ids),
        window=time_window,
        name="executable_name",
        time="run_time",
        event_text="message",
        event_time="timestamp",
    )
    at = iso_timestamp(F.col("run_time"))
    return findings(
        unmatched,
        PREFETCH_WITHOUT_EVENT,
        "medium",
        description=F.concat(
            F.lit("Prefetch records a run of '"), "executable_name", F.lit("' at "), at,
            F.lit(f", but no process-creation event names it within {time_window}."),
        ),
        evidence=[
            F.concat(F.lit("ran at "), at), F.concat(F.lit("recorded by "), "source_path"),
        ],
        details={"executable_name": F.col("executable_name"), "run_time": at},
        ordinal=F.col("run_index"),
    )


def persistence_entries(values: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Values of run-at-startup keys that refer to an executable, with its name."""
    return (
        values.filter(registry.is_persistence_key(F.col("key_path"), segments))
        .withColumn("exe_name", registry.exe_reference(F.col("data.s")))
        .filter(F.col("exe_name").isNotNull())
    )


def executed_names(records: DataFrame) -> DataFrame:
    """Names that prefetch shows as run at least once, in lower case."""
    return records.filter(
        (F.coalesce("executable_name", F.lit("")) != "") & (F.coalesce("run_count", F.lit(0)) != 0)
    ).select("case_id", F.lower("executable_name").alias("exe_key"))


def persistence_without_execution(
    tables: CaseTables,
    persistence_key_segments: Sequence[str] = registry.PERSISTENCE_SEGMENTS,
) -> DataFrame:
    """Run-at-startup values whose executable prefetch never saw."""
    entries = persistence_entries(
        tables.registry_values.select(*_SOURCE, "key_path", "name", "data"),
        persistence_key_segments,
    ).withColumn("exe_key", F.lower("exe_name"))
    gated = only_cases_with(entries, tables.prefetch)
    unseen = not_seen(gated, executed_names(tables.prefetch), ["case_id", "exe_key"])
    label = registry.value_label(F.col("name"))
    return findings(
        unseen,
        PERSISTENCE_WITHOUT_EXECUTION,
        "medium",
        description=F.concat(
            F.lit("Startup entry '"), "key_path", F.lit("\\"), label, F.lit("' refers to '"),
            "exe_name", F.lit("', but prefetch shows no run of it."),
        ),
        evidence=[
            F.concat(F.lit("data "), registry.value_text(F.col("data"))),
            F.concat(F.lit("set under "), "key_path", F.lit(" in "), "source_path"),
        ],
        details={"key_path": F.col("key_path"), "value": label, "exe_name": F.col("exe_name")},
        ordinal=F.lit(0),
    )


def prefetch_hash_mismatch(tables: CaseTables) -> DataFrame:
    """Prefetch files whose name carries another hash than their content."""
    rows = tables.prefetch.filter(F.col("filename_hash_matches") == F.lit(False))
    return findings(
        rows,
        HASH_MISMATCH,
        "high",
        description=F.concat(
            F.lit("The hash in the name of prefetch file '"), basename(F.col("source_path")),
            F.lit("' differs from its embedded hash ("), "prefetch_hash",
            F.lit("); it was renamed or altered."),
        ),
        evidence=[
            F.concat(F.lit("hash inside "), "prefetch_hash"), F.concat(F.lit("file name "), "source_path"),
        ],
        details={"prefetch_hash": F.col("prefetch_hash")},
        ordinal=F.lit(0),
    )


def record_number_gap(
    tables: CaseTables,
    significant_gap_size: int = SIGNIFICANT_GAP,
    evidence_lines: int = EVIDENCE_LINES,
) -> DataFrame:
    """Large gaps in an event log's record numbers, and one summary of its small gaps.

    The summary names the first ``evidence_lines`` small gaps and counts the others. The gaps are found once,
    when the plan is made, and written: three parts of the plan read them.
    """
    found = checkpointed(gaps.record_gaps(tables.events, by=_SOURCE))
    return _large_gaps(gaps.significant(found, significant_gap_size)).unionByName(
        _small_gaps(gaps.minor(found, significant_gap_size), evidence_lines)
    )


def _gap_range() -> Column:
    return F.concat(
        (F.col("previous") + 1).cast("string"), F.lit(" to "), (F.col("current") - 1).cast("string")
    )


def _large_gaps(rows: DataFrame) -> DataFrame:
    return findings(
        rows,
        RECORD_GAP,
        "medium",
        description=F.format_string(
            "%d consecutive records are missing from '%s' between #%d and #%d.",
            F.col("missing"), basename(F.col("source_path")), F.col("previous"), F.col("current"),
        ),
        evidence=[
            F.concat(F.lit("absent "), _gap_range()), F.concat(F.lit("log "), "source_path"),
        ],
        details={c: F.col(c) for c in ("previous", "current", "missing")},
        ordinal=F.col("previous"),
    )


def _small_gaps(rows: DataFrame, evidence_lines: int) -> DataFrame:
    lines = (
        gaps.first_gaps(rows, _SOURCE, evidence_lines)
        .withColumn("line", F.format_string("absent %s, %d in all", _gap_range(), F.col("missing")))
        .groupBy(*_SOURCE)
        .agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    )
    rest = F.col("gap_count") - evidence_lines
    more = F.when(
        rest > 0, F.array(F.format_string("%d further gaps", rest))
    ).otherwise(F.array().cast("array<string>"))
    totals = gaps.summarise(rows, _SOURCE)
    return findings(
        totals.join(lines, list(_SOURCE)),
        RECORD_GAP,
        "info",
        description=F.format_string(
            "'%s' has %d small record number gap(s), %d record(s) missing in all, %d in the largest.",
            basename(F.col("source_path")), F.col("gap_count"), F.col("total_missing"), F.col("largest"),
        ),
        evidence=F.concat(F.col("lines.line"), more),
        details={c: F.col(c) for c in ("gap_count", "total_missing", "largest")},
        # After the source's large gaps, which are numbered by their record.
        ordinal=F.lit(2**63 - 1),
    )


def mft_timestomping(tables: CaseTables) -> DataFrame:
    """File records whose standard times lie before the file's name was made."""
    rows = tables.mft.filter(F.col("likely_timestomped"))
    fields = F.array_join("timestamp_anomalies", ", ")
    return findings(
        rows,
        TIMESTOMPING,
        "high",
        description=F.concat(
            F.lit("File record #"), F.col("record_number").cast("string"), F.lit(" ('"),
            F.coalesce("filename", F.lit("")), F.lit("') has standard times before its name was made."),
        ),
        evidence=[F.concat(F.lit("set back: "), fields)],
        details={"record_number": F.col("record_number"), "anomalies": fields},
        ordinal=F.col("record_number"),
    )
