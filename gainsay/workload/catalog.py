"""Registry of queries: a name, a Spark plan, and the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


# --- stand-in tables, restated in SQL ----------------------------------------------------------

EVENTS_SQL = """
SELECT 'case-' || (user_id % 4) AS case_id, 'logs/user-' || user_id || '.evtx' AS source_path,
       event_id AS record_number,
       CAST(CASE event_type WHEN 'click' THEN 4688 WHEN 'view' THEN 1 ELSE 7 END AS BIGINT) AS event_id,
       ts, event_type AS provider_name, 'HOST-' || (user_id % 10) AS computer_name,
       event_id % 5 AS level, props AS message
FROM events
"""

HASH_NAME_SQL = """
CASE c_custkey % 3 WHEN 0 THEN upper(printf('%08x', c_custkey))
                   WHEN 1 THEN lower(printf('%08x', c_custkey + 1)) END
"""

PREFETCH_FILES_SQL = f"""
SELECT case_id, 'pf\\' || file_name AS source_path, file_name, executable_name, prefetch_hash,
       CASE WHEN in_name IS NULL OR c_custkey % 7 = 0 THEN NULL
            ELSE upper(in_name) = prefetch_hash END AS filename_hash_matches, c_custkey
FROM (SELECT *, c_name || coalesce('-' || in_name, '')
                || CASE WHEN c_custkey % 7 = 0 THEN '.PF' ELSE '.pf' END AS file_name,
             'case-' || (c_custkey % 4) AS case_id, c_name AS executable_name,
             upper(printf('%08x', c_custkey)) AS prefetch_hash
      FROM (SELECT *, {HASH_NAME_SQL} AS in_name FROM customer))
"""

PARTS_RUN_SQL = """
SELECT 'case-' || (p_partkey % 4) AS case_id, lower(p_brand || '.exe') AS exe_key
FROM part WHERE p_size <= 1 AND p_retailprice < 1200
"""

REGISTRY_SQL = """
SELECT 'case-' || (p_partkey % 4) AS case_id,
       'hives/' || (p_partkey % 10) || '/NTUSER.DAT' AS source_path,
       'HKLM\\' || p_type || CASE WHEN p_size % 2 = 0 THEN '\\Run' ELSE '\\RunAs' END AS key_path,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS name,
       CASE WHEN p_size % 10 = 7 THEN NULL ELSE '"C:\\bin\\' || p_brand || '.EXE" -k' END AS s,
       p_brand, p_partkey, p_size
FROM part
"""

SHIPMENTS_SQL = """
SELECT l.*, o.o_orderdate AS ordered FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

MFT_SQL = f"""
SELECT 'case-' || (l_orderkey % 4) AS case_id, 'vol' || (l_suppkey % 8) || '/$MFT' AS source_path,
       l_orderkey * 8 + l_linenumber AS record_number, 'line-' || l_linenumber AS filename,
       l_linestatus = 'F' AS is_directory, l_returnflag <> 'R' AS is_allocated,
       concat_ws(', ',
         CASE WHEN l_shipdate < ordered - INTERVAL 1 SECOND THEN 'creation_time' END,
         CASE WHEN l_shipdate + INTERVAL 30 DAY < ordered - INTERVAL 1 SECOND
              THEN 'modification_time' END) AS anomalies
FROM ({SHIPMENTS_SQL})
"""

ORDERED_GAPS_SQL = """
SELECT user_id, event_id AS previous, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS current
FROM events
"""

USER_GAPS_SQL = f"""
SELECT user_id, previous, current, current - previous - 1 AS missing
FROM ({ORDERED_GAPS_SQL}) WHERE current - previous > 1
"""


def iso_sql(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' "
        f"ELSE strftime({ts}, '.%f') END || '+00:00'"
    )


def escape_sql(text: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        text = f"replace({text}, '{raw}', '{entity}')"
    return text
