"""Queries over whole cases: the five rules, the engine and findings reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.plans import engine, reports, rules
from gainsay.sources.case import CaseTables
from gainsay.workload import standins
from gainsay.workload.catalog import (
    EVENTS_SQL,
    MFT_SQL,
    PARTS_RUN_SQL,
    PREFETCH_FILES_SQL,
    REGISTRY_SQL,
    escape_sql,
    iso_sql,
    query,
)

WINDOW = timedelta(hours=6)

# The event logs' windows in these tables are hours, not minutes.
RULES = (
    engine.Rule(
        rules.PREFETCH_WITHOUT_EVENT,
        lambda tables: rules.prefetch_execution_without_event(tables, time_window=WINDOW),
    ),
    *engine.DEFAULT_RULES[1:],
)

_FACTS = ("rule_name", "severity", "case_id", "source_path", "evidence")

_RUNS_SQL = f"""
SELECT 'prefetch_execution_without_evtx' AS rule_name, 'medium' AS severity, case_id, source_path,
       'ran at ' || {iso_sql('ts')} || chr(10) || 'recorded by ' || source_path AS evidence
FROM (SELECT 'case-' || (user_id % 4) AS case_id, 'pf/run-' || event_id || '.pf' AS source_path,
             '"k": ' || (user_id % 100) || '}}' AS name, ts FROM events WHERE event_type = 'purchase') p
WHERE NOT EXISTS (
  SELECT 1 FROM ({EVENTS_SQL}) e
  WHERE e.case_id = p.case_id AND e.event_id IN (1, 4688)
    AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR
    AND contains(lower(e.message), p.name))
"""

_PERSISTENCE_SQL = f"""
SELECT 'persistence_without_execution' AS rule_name, 'medium' AS severity, case_id, source_path,
       'data {{"kind":"text","s":"\\"C:\\\\bin\\\\' || p_brand || '.EXE\\" -k"}}' || chr(10)
       || 'set under ' || key_path || ' in ' || source_path AS evidence
FROM ({REGISTRY_SQL}) r
WHERE p_size % 2 = 0 AND s IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM ({PARTS_RUN_SQL}) x WHERE x.case_id = r.case_id AND x.exe_key = lower(r.p_brand || '.exe'))
"""

_HASH_SQL = f"""
SELECT 'prefetch_filename_hash_mismatch' AS rule_name, 'high' AS severity, case_id, source_path,
       'hash inside ' || prefetch_hash || chr(10) || 'file name ' || source_path AS evidence
FROM ({PREFETCH_FILES_SQL}) WHERE filename_hash_matches = false
"""

_LOG_GAPS_SQL = f"""
SELECT *, current - previous - 1 AS missing FROM (
  SELECT case_id, source_path, record_number AS previous,
         lead(record_number) OVER (PARTITION BY case_id, source_path ORDER BY record_number) AS current
  FROM ({EVENTS_SQL})) WHERE current - previous > 1
"""

_GAPS_SQL = f"""
SELECT 'evtx_record_number_gap' AS rule_name, 'medium' AS severity, case_id, source_path,
       'absent ' || (previous + 1) || ' to ' || (current - 1) || chr(10) || 'log ' || source_path AS evidence
FROM ({_LOG_GAPS_SQL}) WHERE missing >= 10
UNION ALL
SELECT 'evtx_record_number_gap', 'info', case_id, source_path,
       string_agg('absent ' || (previous + 1) || ' to ' || (current - 1) || ', ' || missing || ' in all', chr(10)
                  ORDER BY previous) FILTER (place <= 10)
       || CASE WHEN count(*) > 10 THEN chr(10) || (count(*) - 10) || ' further gaps' ELSE '' END
FROM (SELECT *, row_number() OVER (PARTITION BY case_id, source_path ORDER BY previous) AS place
      FROM ({_LOG_GAPS_SQL}) WHERE missing < 10) GROUP BY case_id, source_path
"""

_STOMPED_SQL = f"""
SELECT 'mft_timestomping_detected' AS rule_name, 'high' AS severity, case_id, source_path,
       'set back: ' || anomalies AS evidence
FROM ({MFT_SQL}) WHERE anomalies <> ''
"""

ALL_SQL = f"""
SELECT 0 AS rule_ordinal, * FROM ({_RUNS_SQL}) UNION ALL SELECT 1, * FROM ({_PERSISTENCE_SQL})
UNION ALL SELECT 2, * FROM ({_HASH_SQL}) UNION ALL SELECT 3, * FROM ({_GAPS_SQL})
UNION ALL SELECT 4, * FROM ({_STOMPED_SQL})
"""


def _facts(found: DataFrame, *more: str) -> DataFrame:
    return found.select(
        *more, "rule_name", "severity", "case_id",
        F.get("source_paths", F.lit(0)).alias("source_path"),
        F.array_join("evidence", "\n").alias("evidence"),
    )


@query(_RUNS_SQL)
def rule_prefetch_execution_without_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(RULES[0].evaluate(standins.case_tables(spark, sf_dir)))


@query(_PERSISTENCE_SQL)
def rule_persistence_without_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(rules.persistence_without_execution(standins.case_tables(spark, sf_dir)))


@query(_HASH_SQL)
def rule_prefetch_hash_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(rules.prefetch_hash_mismatch(standins.case_tables(spark, sf_dir)))


@query(_GAPS_SQL)
def rule_record_number_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(rules.record_number_gap(standins.case_tables(spark, sf_dir)))


@query(_STOMPED_SQL)
def rule_mft_timestomping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(rules.mft_timestomping(standins.case_tables(spark, sf_dir)))


@query(f"""
SELECT CAST(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS INTEGER) AS severity_rank,
       CAST(rule_ordinal AS INTEGER) AS rule_ordinal, rule_name, severity, case_id, source_path, evidence
FROM ({ALL_SQL})
""")
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.run(standins.case_tables(spark, sf_dir), RULES)
    return _facts(found, "severity_rank", "rule_ordinal")


@query(f"SELECT severity, count(*) AS finding_count FROM ({ALL_SQL}) GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_counts(
        engine.run(standins.case_tables(spark, sf_dir), RULES, ordered=False)
    )


@query(f"""
SELECT count(*) AS findings, count(DISTINCT rule_name) AS rules, count(DISTINCT source_path) AS sources FROM ({ALL_SQL})
""")
def isolated_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that cannot work takes nothing away from the others."""
    broken = engine.Rule("broken", lambda tables: tables.events.select("no_such_column"))
    found, _ = engine.run_isolated(
        standins.case_tables(spark, sf_dir), (broken, *RULES), ordered=False
    )
    return found.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct("rule_name").alias("rules"),
        F.count_distinct(F.get("source_paths", F.lit(0))).alias("sources"),
    )


@query("""
SELECT 'events' AS table_name, count(*) AS row_count FROM events
UNION ALL SELECT 'registry_values', count(*) FROM part
UNION ALL SELECT 'prefetch', (SELECT count(*) FROM events WHERE event_type = 'purchase')
         + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part)
UNION ALL SELECT 'mft', (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
""")
def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.case_tables(spark, sf_dir).row_counts()


_DESCRIPTION_SQL = """
'The hash in the name of prefetch file ''' || file_name || ''' differs from its embedded hash ('
|| prefetch_hash || '); it was renamed or altered.'
"""


_HASH_ROW_SQL = f"""
'<tr data-severity="high"><th>prefetch_filename_hash_mismatch</th><td>' || {escape_sql(_DESCRIPTION_SQL)}
|| '</td><td><ul><li>hash inside ' || prefetch_hash || '</li><li>file name ' || {escape_sql('source_path')}
|| '</li></ul></td><td>' || {escape_sql('source_path')} || '</td></tr>'
"""


@query(f"SELECT {_HASH_ROW_SQL} AS value FROM ({PREFETCH_FILES_SQL}) WHERE filename_hash_matches = false")
def findings_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.findings_report(rules.prefetch_hash_mismatch(standins.case_tables(spark, sf_dir)))


@query(f"""
SELECT concat_ws(chr(10), '[HIGH] prefetch_filename_hash_mismatch', {_DESCRIPTION_SQL},
                 '* hash inside ' || prefetch_hash, '* file name ' || source_path, 'in ' || source_path) AS detail
FROM ({PREFETCH_FILES_SQL}) WHERE filename_hash_matches = false
""")
def finding_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.prefetch_hash_mismatch(standins.case_tables(spark, sf_dir))
    return found.select(reports.finding_detail().alias("detail"))


@query(f"""
SELECT {_HASH_ROW_SQL} AS value FROM ({PREFETCH_FILES_SQL}) WHERE filename_hash_matches = false AND prefetch_hash = '00000000'
UNION ALL
SELECT '<tr data-severity="none"><td>nothing was found</td></tr>' WHERE NOT EXISTS (
  SELECT 1 FROM ({PREFETCH_FILES_SQL}) WHERE filename_hash_matches = false AND prefetch_hash = '00000000')
""")
def empty_findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files are compared; none of those that differ has the hash zero."""
    found = rules.prefetch_hash_mismatch(standins.case_tables(spark, sf_dir))
    zero = F.get_json_object("details", "$.prefetch_hash") == "00000000"
    return reports.findings_report(found.filter(zero))


@query(f"""
SELECT 'busy_log' AS rule_name, case_id, source_path, count(*) AS records
FROM ({EVENTS_SQL}) GROUP BY case_id, source_path HAVING count(*) > 10
""")
def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of the caller's own, run by the engine like the built-in ones."""

    def busy_logs(tables: CaseTables) -> DataFrame:
        counted = tables.events.groupBy("case_id", "source_path").agg(F.count(F.lit(1)).alias("records"))
        return rules.findings(
            counted.filter(F.col("records") > 10), "busy_log", "low",
            description=F.lit("A log with many records."), evidence=[F.col("records").cast("string")],
            details={"records": F.col("records")}, ordinal=F.lit(0),
        )

    found = engine.run(standins.case_tables(spark, sf_dir), (engine.Rule("busy_log", busy_logs),), ordered=False)
    return found.select(
        "rule_name", "case_id", F.get("source_paths", F.lit(0)).alias("source_path"),
        F.get_json_object("details", "$.records").cast("bigint").alias("records"),
    )
