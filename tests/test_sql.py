"""SQL functions against their Column forms."""

import re

import pytest
from pyspark.sql import functions as F

from gainsay import Rule, sql
from gainsay.functions import prefetch, registry, text, time
from gainsay.operators import gaps
from gainsay.plans import rules
from gainsay.workload import standins

SF = "/root/testdata/sf0.001"
SLOTS = "transform(sequence(0, n), i -> IF(i = bad, NULL, timestamp_seconds(i * 1000)))"


@pytest.fixture(scope="module")
def rows(spark):
    sql.register_scalars(spark)
    paths = [r"C:\Users\a\CALC.EXE-0000ABCD.pf", "/x/y-1234abcd.pf", "y-1234ABCD.PF", "", None, r"HKLM\Run", r"HKLM\RunAs\x", r"a\RUNONCE\b"]
    texts = ['"C:\\x y\\Evil.EXE" -k', "none", "a.exe b.exe", None, "x/y.exe.exe", "", "é.exe", "run"]
    numbers = [0, 43981, 0xFFFFFFFF, None, -1, 2**32, 2650467743999999999, 2650467744000000000]
    data = [(p, t, n, h, k, b) for p, t, n, h, k, b in zip(
        paths, texts, numbers, ["0000abcd", "1234ABCE", "1234abcd", "x", None, "a", "b", "c"], range(0, 16, 2), [9, 0, 3, 9, 8, 1, 9, 4])]
    made = spark.createDataFrame(data, "path string, text string, number bigint, hash string, n int, bad int")
    made = made.withColumn("slots", F.expr(SLOTS)).withColumn("slots", F.when(F.col("n") > 0, F.col("slots")))
    made.createOrReplaceTempView("sql_rows")
    return made


COLUMN_FORMS = {
    "base_name(path)": lambda: text.basename(F.col("path")),
    "is_persistence_key(path)": lambda: registry.is_persistence_key(F.col("path")),
    "is_persistence_key(path, array('RunAs'))": lambda: registry.is_persistence_key(F.col("path"), ["RunAs"]),
    "exe_reference(text)": lambda: registry.exe_reference(F.col("text")),
    "value_label(text)": lambda: registry.value_label(F.col("text")),
    "hash_hex(number)": lambda: prefetch.hash_hex(F.col("number")),
    "filename_hash_matches(path, hash)": lambda: prefetch.filename_hash_matches(F.col("path"), F.col("hash")),
    "filetime_to_timestamp(number)": lambda: time.filetime_to_timestamp(F.col("number")),
    "timestamp_to_filetime(filetime_to_timestamp(number))": lambda: time.timestamp_to_filetime(time.filetime_to_timestamp(F.col("number"))),
    "run_times(slots)": lambda: prefetch.run_times(F.col("slots")),
}


@pytest.mark.parametrize("call", COLUMN_FORMS)
def test_scalar_functions_equal_their_column_forms(spark, rows, call):
    both = rows.select(F.expr(call).cast("string").alias("sql"), COLUMN_FORMS[call]().cast("string").alias("column"))
    found = both.collect()
    assert [r.sql for r in found] == [r.column for r in found]
    assert any(r.sql is not None for r in found)
    assert not re.search("Python|Join|Subquery", both._jdf.queryExecution().optimizedPlan().toString())


def test_table_functions(spark):
    tables = standins.case_tables(spark, SF)
    lazy = [Rule(rules.TIMESTOMPING, rules.mft_timestomping), Rule(rules.HASH_MISMATCH, rules.prefetch_hash_mismatch)]
    sql.register(spark, tables, lazy)
    expected = gaps.record_gaps(tables.events, by=["case_id", "source_path"])
    for call, wanted in (
        ("record_gaps()", expected),
        ("record_gaps(10)", gaps.significant(expected)),
        ("record_gaps(least => 10, in_case => 'case-1')", gaps.significant(expected).filter("case_id = 'case-1'")),
        ("record_gaps(in_case => 'none')", expected.limit(0)),
    ):
        found = spark.sql(f"SELECT * FROM {call}")
        assert found.columns == expected.columns
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    stomped = rules.mft_timestomping(tables)
    found = spark.sql(f"SELECT description FROM {rules.TIMESTOMPING}(in_case => 'case-2')")
    assert sorted(r[0] for r in found.collect()) == sorted(
        r.description for r in stomped.filter("case_id = 'case-2'").select("description").collect())
    # One call per row of another table, as a join and not as a loop.
    per_case = spark.sql(f"""
        SELECT c.id, count(*) n FROM VALUES ('case-1'), ('case-3'), ('none') c(id),
               LATERAL {rules.TIMESTOMPING}(in_case => c.id) GROUP BY c.id""")
    counts = {r.case_id: r["count"] for r in stomped.groupBy("case_id").count().collect()}
    assert {r.id: r.n for r in per_case.collect()} == {c: counts[c] for c in ("case-1", "case-3")}
