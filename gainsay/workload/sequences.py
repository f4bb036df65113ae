"""Queries over event numbers and times: gaps and window presence."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.functions.text import iso_timestamp
from gainsay.functions.time import utc
from gainsay.operators import gaps
from gainsay.operators.presence import unmatched_in_window
from gainsay.operators.rows import only_cases_with
from gainsay.plans import rules
from gainsay.workload import standins
from gainsay.workload.catalog import EVENTS_SQL, USER_GAPS_SQL, iso_sql, query

WINDOW = timedelta(hours=6)


def _user_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.record_gaps(standins.read(spark, sf_dir, "events"), by=["user_id"], number="event_id")


@query(USER_GAPS_SQL)
def record_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_gaps(spark, sf_dir)


@query(f"SELECT * FROM ({USER_GAPS_SQL}) WHERE missing >= 10")
def record_gap_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.significant(_user_gaps(spark, sf_dir))


@query(f"""
SELECT user_id, count(*) AS gap_count, CAST(sum(missing) AS BIGINT) AS total_missing,
       max(missing) AS largest
FROM ({USER_GAPS_SQL}) WHERE missing < 10 GROUP BY user_id
""")
def record_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.summarise(gaps.minor(_user_gaps(spark, sf_dir)), ["user_id"])


_SMALL_USER_GAPS_SQL = """
SELECT * FROM (SELECT user_group, previous, current, current - previous - 1 AS missing FROM (
  SELECT user_id % 8 AS user_group, event_id AS previous,
         lead(event_id) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS current FROM events)
  WHERE current - previous > 1) WHERE missing < 10
"""


def _small_group_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources coarse enough to have many small gaps each."""
    rows = standins.read(spark, sf_dir, "events").withColumn("user_group", F.col("user_id") % 8)
    return gaps.minor(gaps.record_gaps(rows, by=["user_group"], number="event_id"))


@query(f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_group ORDER BY previous) AS INTEGER) AS place
               FROM ({_SMALL_USER_GAPS_SQL})) WHERE place <= 10
""")
def record_gap_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.first_gaps(_small_group_gaps(spark, sf_dir), ["user_group"])


@query("""
SELECT 'many.evtx' AS source_path, string_agg(line, chr(10) ORDER BY place) FILTER (place <= 10)
       || CASE WHEN count(*) > 10 THEN chr(10) || (count(*) - 10) || ' further gaps' ELSE '' END AS evidence
FROM (SELECT 'absent ' || (previous + 1) || ' to ' || (current - 1) || ', ' || (current - previous - 1) || ' in all' AS line,
             row_number() OVER (ORDER BY previous) AS place
      FROM (SELECT event_id AS previous, lead(event_id) OVER (ORDER BY event_id) AS current
            FROM events WHERE event_id % 3 > 0) WHERE current - previous BETWEEN 2 AND 10)
""")
def small_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which every third record is missing: ten gaps are named, the others counted."""
    rows = standins.events(spark, sf_dir).filter(F.col("record_number") % 3 > 0)
    one_log = rows.withColumns({"case_id": F.lit("case"), "source_path": F.lit("many.evtx")})
    tables = standins.CaseTables.build(spark, events=one_log)
    found = rules.record_number_gap(tables).filter(F.col("severity") == "info")
    return found.select(
        F.get("source_paths", F.lit(0)).alias("source_path"), F.array_join("evidence", "\n").alias("evidence")
    )


def _probes(spark: SparkSession, sf_dir: str, case_id=None) -> DataFrame:
    rows = standins.read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return rows.select(
        (F.lit("case") if case_id is None else case_id).alias("case_id"),
        "event_id",
        F.concat(F.lit('"K": '), (F.col("user_id") % 100).cast("string"), F.lit("}")).alias("name"),
        utc(F.col("ts")).alias("time"),
    )


def _texts(spark: SparkSession, sf_dir: str, case_id=None) -> DataFrame:
    rows = standins.read(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    return rows.select(
        (F.lit("case") if case_id is None else case_id).alias("case_id"),
        F.col("props").alias("text"),
        utc(F.col("ts")).alias("time"),
    )


_UNMATCHED_SQL = """
SELECT p.event_id, p.user_id % 100 AS wanted FROM events p
WHERE p.event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM events e
  WHERE e.event_type IN ('click', 'view')
    AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR
    AND contains(lower(e.props), '"k": ' || (p.user_id % 100) || '}'))
"""


def _unmatched(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    left = unmatched_in_window(_probes(spark, sf_dir), _texts(spark, sf_dir), window=WINDOW, **options)
    return left.select("event_id", F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("wanted"))


@query(_UNMATCHED_SQL)
def execution_without_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unmatched(spark, sf_dir)


@query(_UNMATCHED_SQL)
def execution_without_event_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if there were too many names to broadcast: a bitmap picks the places that are shuffled."""
    return _unmatched(spark, sf_dir, broadcast_limit=0)


@query("""
SELECT 'case-' || (p.user_id % 4) AS case_id, p.event_id FROM events p
WHERE p.event_type = 'purchase'
  AND p.user_id % 4 IN (SELECT user_id % 4 FROM events WHERE user_id % 4 < 2)
  AND NOT EXISTS (
    SELECT 1 FROM events e
    WHERE e.event_type IN ('click', 'view') AND e.user_id % 4 = p.user_id % 4 AND e.user_id % 4 < 2
      AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR
      AND contains(lower(e.props), '"k": ' || (p.user_id % 100) || '}'))
""")
def gated_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases 2 and 3 have no events at all, so nothing can be said about them."""
    case_id = standins.case_of("user_id")
    texts = _texts(spark, sf_dir, case_id).filter(F.col("case_id").isin("case-0", "case-1"))
    probes = only_cases_with(_probes(spark, sf_dir, case_id), texts)
    return unmatched_in_window(probes, texts, window=WINDOW).select("case_id", "event_id")


@query("""
WITH texts AS (
  SELECT user_id % 4 AS c, lower(props) AS text, ts - CASE WHEN user_id % 4 = 0 THEN INTERVAL 9000 DAY ELSE INTERVAL 0 DAY END AS ts
  FROM events WHERE contains(props, '"k": 1}') AND user_id % 4 <> 3)
SELECT 'case-' || (p.user_id % 4) AS case_id, p.event_id FROM events p
WHERE p.event_type = 'purchase' AND p.user_id % 4 IN (SELECT c FROM texts)
  AND NOT EXISTS (SELECT 1 FROM texts e WHERE e.c = p.user_id % 4
    AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR
    AND contains(e.text, '"k": ' || (p.user_id % 100) || '}'))
""")
def gated_anti_join_without_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case has its say only if some event of it holds the text: case 3 has none, the events of case 0 are too
    far off in time to name a run, those of the others name some."""
    case_id = standins.case_of("user_id")
    rows = standins.read(spark, sf_dir, "events")
    at = utc(F.col("ts"))
    texts = rows.filter(F.contains("props", F.lit('"k": 1}')) & (F.col("user_id") % 4 != 3)).select(
        case_id.alias("case_id"), F.col("props").alias("text"),
        F.when(F.col("user_id") % 4 == 0, at - F.expr("INTERVAL '9000' DAY")).otherwise(at).alias("time"),
    )
    probes = only_cases_with(_probes(spark, sf_dir, case_id), texts)
    return unmatched_in_window(probes, texts, window=WINDOW).select("case_id", "event_id")


@query(f"""
SELECT case_id, source_path, record_number, event_id, {iso_sql('ts')} AS at
FROM ({EVENTS_SQL}) WHERE event_id IN (1, 4688) AND ts IS NOT NULL
""")
def process_creation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.process_creations(standins.events(spark, sf_dir))
    return rows.select(
        "case_id", "source_path", "record_number", "event_id",
        iso_timestamp(F.col("timestamp")).alias("at"),
    )
