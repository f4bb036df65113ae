"""Queries written in SQL over the session's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gainsay import sql
from gainsay.plans import rules
from gainsay.plans.engine import Rule
from gainsay.workload import standins
from gainsay.workload.catalog import ORACLE, ORDERED_GAPS_SQL, PREFETCH_FILES_SQL, REGISTRY_SQL, query


def _session(spark: SparkSession, sf_dir: str, *rule: Rule) -> SparkSession:
    """A session of its own, so that views and functions take no name in the caller's."""
    session = spark.newSession()
    sql.register(session, standins.case_tables(session, sf_dir), rule)
    standins.registry_values(session, sf_dir).createOrReplaceTempView("startup")
    standins.prefetch_files(session, sf_dir).createOrReplaceTempView("prefetch_files")
    return session


@query(f"""
SELECT p_partkey, p_brand || '.EXE' AS exe_name, name IS NULL OR name = '' AS is_default
FROM ({REGISTRY_SQL}) WHERE p_size % 2 = 0 AND s IS NOT NULL
""")
def sql_startup_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).sql("""
        SELECT p_partkey, exe_reference(data.s) AS exe_name, value_label(name) = '(default)' AS is_default
        FROM startup WHERE is_persistence_key(key_path) AND exe_reference(data.s) IS NOT NULL
    """)


@query(f"""
SELECT file_name, prefetch_hash AS hash, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 3 < 2 THEN c_custkey % 3 = 0 END AS matches
FROM ({PREFETCH_FILES_SQL})
""")
def sql_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).sql("""
        SELECT base_name(source_path) AS file_name, hash_hex(CAST(conv(prefetch_hash, 16, 10) AS BIGINT)) AS hash,
               filename_hash_matches(source_path, prefetch_hash) AS matches
        FROM prefetch_files
    """)


@query(f"""
SELECT 'case-' || (user_id % 4) AS case_id, count(*) AS gap_count, CAST(sum(current - previous - 1) AS BIGINT) AS missing
FROM ({ORDERED_GAPS_SQL}) WHERE current - previous > 10 GROUP BY 1
""")
def sql_record_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir).sql("""
        SELECT case_id, count(*) AS gap_count, sum(missing) AS missing FROM record_gaps(least => 10) GROUP BY case_id
    """)


@query(f"""
SELECT case_id, source_path, evidence FROM ({ORACLE["rule_mft_timestomping"]}) WHERE case_id IN ('case-1', 'case-2')
""")
def sql_timestomping_of_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule called once per case of a list, as a join."""
    return _session(spark, sf_dir, Rule(rules.TIMESTOMPING, rules.mft_timestomping)).sql(f"""
        SELECT f.case_id, source_paths[0] AS source_path, array_join(evidence, '\n') AS evidence
        FROM VALUES ('case-1'), ('case-2'), ('no such case') wanted(id),
             LATERAL {rules.TIMESTOMPING}(in_case => wanted.id) f
    """)
