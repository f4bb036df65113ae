"""Queries over orders of whole tables: positions, sessions, nearest events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.operators.order import nearest, numbered
from gainsay.plans import engine, timeline as plans
from gainsay.sources.case import CaseTables
from gainsay.workload import standins
from gainsay.workload.catalog import EVENTS_SQL, SHIPMENTS_SQL, query
from gainsay.workload.findings import ALL_SQL, RULES

IDLE = timedelta(hours=1)


def _timed_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    """Events, and file records of order lines: written at shipping, changed a month later, named at the order."""
    rows = standins.shipments(spark, sf_dir)
    none = F.lit(None).cast("timestamp")

    def times(created, modified):
        return F.struct(
            created.alias("creation_time"), modified.alias("modification_time"),
            none.alias("mft_modification_time"), none.alias("access_time"),
        )

    shipped = F.col("shipped")
    files = rows.select(
        standins.case_of("l_orderkey").alias("case_id"),
        F.concat(F.lit("vol"), (F.col("l_suppkey") % 8).cast("string"), F.lit("/$MFT")).alias("source_path"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_number"),
        F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("filename"),
        times(shipped, shipped + F.expr("INTERVAL '30' DAY")).alias("standard_information"),
        times(F.col("ordered"), none).alias("file_name_information"),
    )
    return CaseTables.build(spark, events=standins.events(spark, sf_dir), mft=files)


_FILES_SQL = f"""
SELECT 'case-' || (l_orderkey % 4) AS case_id, 'vol' || (l_suppkey % 8) || '/$MFT' AS source_path,
       l_orderkey * 8 + l_linenumber AS number, 'line-' || l_linenumber AS label, l_shipdate AS shipped, ordered
FROM ({SHIPMENTS_SQL})
"""

_ENTRIES_SQL = f"""
SELECT case_id, ts AS moment, 'event' AS kind, source_path, record_number AS number, provider_name AS label FROM ({EVENTS_SQL})
UNION ALL SELECT case_id, shipped, 'file creation_time', source_path, number, label FROM ({_FILES_SQL})
UNION ALL SELECT case_id, shipped + INTERVAL 30 DAY, 'file modification_time', source_path, number, label FROM ({_FILES_SQL})
UNION ALL SELECT case_id, ordered, 'name creation_time', source_path, number, label FROM ({_FILES_SQL})
"""


@query(f"""
SELECT case_id, epoch_us(moment) AS at_micros, kind, source_path, number, position, CAST(sum(opens) OVER (ORDER BY position) AS BIGINT) AS session
FROM (SELECT *, row_number() OVER (ORDER BY case_id, moment, kind, source_path, number, label) AS position,
             CASE WHEN moment - lag(moment) OVER (PARTITION BY case_id ORDER BY moment, kind, source_path, number, label) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens
      FROM ({_ENTRIES_SQL}) WHERE moment IS NOT NULL)
""")
def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, orders and order lines as one stream; a session ends after an hour without any."""
    found = plans.timeline(_timed_tables(spark, sf_dir), idle=IDLE)
    return found.select(
        "case_id", F.unix_micros("at").alias("at_micros"), "kind", "source_path", "number", "position", "session"
    )


@query(f"""
WITH e AS (SELECT case_id, ts, min(record_number) AS event_number FROM ({EVENTS_SQL}) WHERE ts IS NOT NULL GROUP BY case_id, ts),
     f AS (SELECT * FROM ({_FILES_SQL})),
     n AS (SELECT f.*, b.event_number AS b_event, a.event_number AS a_event,
                  epoch_us(f.shipped) - epoch_us(b.ts) AS b_far, epoch_us(a.ts) - epoch_us(f.shipped) AS a_far
           FROM f ASOF LEFT JOIN e b ON f.case_id = b.case_id AND f.shipped >= b.ts
                ASOF LEFT JOIN e a ON f.case_id = a.case_id AND f.shipped <= a.ts)
SELECT case_id, source_path, number AS record_number,
       CASE WHEN a_far IS NULL OR b_far <= a_far THEN b_event ELSE a_event END AS event_number,
       CASE WHEN a_far IS NULL OR b_far <= a_far THEN -b_far ELSE a_far END AS micros
FROM n
""")
def nearest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event nearest to the creation of every file record, in its case."""
    found = plans.nearest_events(_timed_tables(spark, sf_dir))
    return found.select(
        "case_id", "source_path", "record_number", F.col("nearest.event_number").alias("event_number"),
        F.col("nearest.micros").alias("micros"),
    )


@query("""
SELECT o_orderkey, l.l_suppkey AS shipper, epoch_us(o_orderdate) - epoch_us(l.l_shipdate) AS waited
FROM orders ASOF LEFT JOIN (SELECT l_shipdate, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_shipdate) l
  ON o_orderdate >= l.l_shipdate
""")
def last_shipment_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for all rows: the last shipment at or before every order, of any customer."""
    one = F.lit("all")
    orders = standins.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", one.alias("case_id"))
    lines = standins.read(spark, sf_dir, "lineitem").select("l_shipdate", "l_suppkey", one.alias("case_id"))
    found = nearest(
        orders.withColumn("o_orderdate", standins.utc(F.col("o_orderdate"))),
        lines.withColumn("l_shipdate", standins.utc(F.col("l_shipdate"))),
        by=["case_id"], left_time="o_orderdate", right_time="l_shipdate", take=["l_suppkey"], after=False,
    )
    return found.select(
        "o_orderkey", F.col("nearest.l_suppkey").alias("shipper"), (-F.col("nearest.micros")).alias("waited")
    )


@query("""
SELECT event_id, row_number() OVER (ORDER BY event_type DESC, ts, event_id) AS position FROM events
""")
def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.read(spark, sf_dir, "events")
    return numbered(rows, [F.col("event_type").desc(), "ts", "event_id"]).select("event_id", "position")


@query(f"""
SELECT rule_name, severity, case_id, source_path, findings,
       CAST(sum(findings) OVER (ORDER BY severity_rank DESC, rule_ordinal, case_id, source_path) AS BIGINT) AS last_position
FROM (SELECT CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank,
             rule_ordinal, rule_name, severity, case_id, source_path, count(*) AS findings
      FROM ({ALL_SQL}) GROUP BY ALL)
""")
def finding_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the findings of each rule and source end in the order of all; nothing else of them is rendered."""
    found = engine.ranked(
        standins.case_tables(spark, sf_dir), RULES, columns=["rule_name", "severity", "case_id", "source_paths"]
    )
    return found.groupBy("rule_name", "severity", "case_id", F.get("source_paths", F.lit(0)).alias("source_path")).agg(
        F.count(F.lit(1)).alias("findings"), F.max("position").alias("last_position")
    )
