"""Ordered report files: all of a report or nothing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gainsay.plans import reports
from gainsay.sources.report_files import file_stem
from gainsay.workload.artifacts import event_report_files
from gainsay.workload.catalog import ORACLE
from oracle import compare, connect

SCHEMA = "case_id string, source_path string, section string, place bigint, value string"


def _files(folder):
    root = Path(folder)
    return {str(f.relative_to(root)): f.read_text() for f in root.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def test_one_ordered_file_per_source(spark, tmp_path):
    rows = [("c", f"a/{s}", "1-records", n, f"{s}-{n}") for s in range(5) for n in range(40, 0, -1)]
    rows += [("c", "a/0", "2-failures", 1, "bad"), (None, None, "1-records", None, "odd"), ("c", "é .", "1-records", 1, None)]
    report = spark.createDataFrame(rows, SCHEMA).repartition(7)
    reports.write_report_files(report, str(tmp_path / "r"))
    expected = {
        f"case=c/report=a%2F{s}.00000.html": "".join(f"{s}-{n}\n" for n in range(1, 41)) + ("bad\n" if s == 0 else "")
        for s in range(5)
    }
    expected["case=__HIVE_DEFAULT_PARTITION__/report=__HIVE_DEFAULT_PARTITION__.00000.html"] = "odd\n"
    expected["case=c/report=%C3%A9 ..00000.html"] = "\n"
    assert _joined(_files(tmp_path / "r")) == _joined(expected)


def _joined(files):
    """Text per source, further files after the first."""
    out = {}
    for name in sorted(files):
        stem = name.rsplit(".", 2)[0]
        out[stem] = out.get(stem, "") + files[name]
    return out


def test_a_huge_log_is_split_and_stays_in_order(spark, tmp_path):
    report = spark.range(40).selectExpr(
        "'c' case_id", "'log' source_path", "'1-records' section", "(39 - id) << 20 place", "string(39 - id) value")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        reports.write_report_files(report, str(tmp_path / "r"))
    finally:
        spark.conf.unset(coalesce)
    files = _files(tmp_path / "r")
    assert len(files) > 1 and sorted(files)[0] == "case=c/report=log.00000.html"
    assert "".join(files[name] for name in sorted(files)).split() == [str(n) for n in range(40)]


def test_a_huge_log_is_one_file_where_that_is_asked_for(spark, tmp_path):
    report = spark.range(40).selectExpr(
        "'c' case_id", "if(id < 3, 'other', 'a log') source_path", "'1-records' section", "(39 - id) << 20 place", "string(39 - id) value")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        reports.write_report_files(report, str(tmp_path / "r"), whole=True)
    finally:
        spark.conf.unset(coalesce)
    lines = lambda numbers: "".join(f"{n}\n" for n in numbers)
    assert _files(tmp_path / "r") == {
        "case=c/report=a log.00000.html": lines(range(37)), "case=c/report=other.00000.html": lines(range(37, 40))
    }


def test_event_report_files_of_long_logs_are_those_of_the_sql(spark, tmp_path):
    spark.range(60).selectExpr(
        "id * 200000 event_id", "timestamp_seconds(1700000000 + id)::timestamp_ntz ts", "id % 2 user_id", "'click' event_type", "1D value", "'{}' props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    duck = connect("/root/testdata/sf0.001")
    duck.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        count, problem = compare(spark, duck, str(tmp_path), event_report_files, ORACLE["event_report_files"])
    finally:
        spark.conf.unset(coalesce)
    assert problem is None and count == 2


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "r"
    report = spark.range(100).selectExpr(
        "'c' case_id", "concat('log-', id % 10) source_path", "'1-records' section", "id place", "string(id) value")
    reports.write_report_files(report, str(folder))
    before = _files(folder)
    fails = report.withColumn("value", F.when(F.col("place") == 77, F.raise_error(F.lit("no"))).otherwise("new"))
    with pytest.raises(Exception, match="no"):
        reports.write_report_files(fails, str(folder))
    assert _files(folder) == before and len(before) == 10
    with pytest.raises(Exception, match="has reports of these sources"):
        reports.write_report_files(report, str(folder), mode="append")
    assert _files(folder) == before
    assert not [f for f in folder.iterdir() if f.name.startswith("_staging")]
    more = report.withColumn("case_id", F.lit("d"))
    reports.write_report_files(more, str(folder), mode="append")
    assert len(_files(folder)) == 20
    reports.write_report_files(report.limit(0), str(folder))
    assert _files(folder) == {}


def test_names_of_files_are_safe_and_differ():
    sources = ["", ".", "..", "a/b", "a\\b", "a%2Fb", "_x", "x" * 5000, "x" * 5001, "é" * 300, None]
    stems = [file_stem("..", s) for s in sources]
    assert len(set(stems)) == len(sources)
    assert all(len(part.encode()) <= 255 - len(".00000.html") for stem in stems for part in stem.split("/"))
    assert all(stem.startswith("case=../report=") and stem.count("/") == 1 for stem in stems)
