"""The scalar functions, the gaps and the rules for use from SQL.

    register(spark, tables)
    spark.sql("SELECT key_path, exe_reference(data.s) FROM registry_values WHERE is_persistence_key(key_path)")
    spark.sql("SELECT * FROM record_gaps(least => 10) WHERE case_id = 'case-7'")
    spark.sql("SELECT c.id, f.* FROM cases c, LATERAL mft_timestomping_detected(in_case => c.id) f")

All are temporary SQL functions of the session. Spark puts their bodies in place of the calls when it plans a
query, so filters and column pruning go through them and no Python runs. A name already taken by such a function
is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from gainsay.functions.prefetch import MAX_RUN_TIMES, PF_NAME_PATTERN
from gainsay.functions.registry import EXE_PATTERN, PERSISTENCE_SEGMENTS
from gainsay.functions.time import EPOCH_OFFSET_MICROS, LAST_FILETIME
from gainsay.operators.gaps import record_gaps
from gainsay.plans.engine import DEFAULT_RULES, Rule
from gainsay.schemas import FINDINGS
from gainsay.sources.case import CaseTables

_SEGMENTS = ", ".join(f"'{segment}'" for segment in PERSISTENCE_SEGMENTS)

# Name, parameters, result and body. A null argument gives null, where the body does not say otherwise.
SCALARS = (
    ("base_name", "path STRING", "STRING", r"regexp_extract(path, r'[^\\/]+$', 0)"),
    (
        "is_persistence_key",
        f"key_path STRING, segments ARRAY<STRING> DEFAULT array({_SEGMENTS})",
        "BOOLEAN",
        r"arrays_overlap(split(lower(key_path), r'\\'), transform(segments, s -> lower(s)))",
    ),
    ("exe_reference", "text STRING", "STRING", f"nullif(regexp_extract(text, r'{EXE_PATTERN}', 1), '')"),
    ("value_label", "name STRING", "STRING", "CASE WHEN coalesce(name, '') = '' THEN '(default)' ELSE name END"),
    ("hash_hex", "value BIGINT", "STRING", "CASE WHEN value BETWEEN 0 AND 4294967295 THEN lpad(hex(value), 8, '0') END"),
    (
        "filename_hash_matches",
        "path STRING, embedded STRING",
        "BOOLEAN",
        f"upper(nullif(regexp_extract(regexp_extract(path, r'[^\\\\/]+$', 0), r'{PF_NAME_PATTERN}', 2), '')) = upper(embedded)",
    ),
    (
        "filetime_to_timestamp",
        "ticks BIGINT",
        "TIMESTAMP",
        f"CASE WHEN ticks > 0 AND ticks <= {LAST_FILETIME} THEN timestamp_micros(ticks DIV 10 - {EPOCH_OFFSET_MICROS}) END",
    ),
    (
        "timestamp_to_filetime", "at TIMESTAMP", "BIGINT", f"(unix_micros(at) + {EPOCH_OFFSET_MICROS}) * 10",
    ),
    (
        "run_times",
        "slots ARRAY<TIMESTAMP>",
        "ARRAY<TIMESTAMP>",
        f"coalesce(filter(slice(slots, 1, {MAX_RUN_TIMES}), "
        "(t, i) -> forall(slice(slots, 1, i + 1), s -> s IS NOT NULL)), array())",
    ),
)

_FINDING_COLUMNS = ("case_id", "severity", "ordinal", "description", "evidence", "source_paths", "details")


def register_scalars(spark: SparkSession) -> None:
    """The scalar functions; none needs any table."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def register_table_function(
    spark: SparkSession, name: str, rows: DataFrame, parameters: str, condition: str
) -> None:
    """A function of ``parameters`` that gives the ``rows`` for which ``condition`` holds.

    The rows are kept as a view; the condition is pushed into its plan wherever it is used.
    """
    view = f"_{name}_rows"
    rows.createOrReplaceTempView(view)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    listed = ", ".join(f"`{c}`" for c in rows.columns)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) "
        f"RETURN SELECT {listed} FROM {view} WHERE {condition}"
    )


def register(spark: SparkSession, tables: CaseTables, rules: Iterable[Rule] | None = None) -> None:
    """Everything: the scalar functions, the case tables as views, ``record_gaps`` and a function per rule.

    ``record_gaps(least, in_case)`` gives the gaps of at least so many numbers. A rule's function has the rule's
    name and gives its findings; ``in_case`` null, the default, means all cases. None means the default rules, whose
    first and fourth run a job when they are planned (see ``gainsay.plans.engine.run``).
    """
    register_scalars(spark)
    tables.create_views()
    one_case = "(in_case IS NULL OR case_id = in_case)"
    found = record_gaps(tables.events, by=["case_id", "source_path"])
    register_table_function(
        spark, "record_gaps", found, "least BIGINT DEFAULT 1, in_case STRING DEFAULT NULL", f"missing >= least AND {one_case}"
    )
    for rule in DEFAULT_RULES if rules is None else rules:
        rows = rule.evaluate(tables).select(*FINDINGS.names).select(*_FINDING_COLUMNS)
        register_table_function(spark, rule.name, rows, "in_case STRING DEFAULT NULL", one_case)
