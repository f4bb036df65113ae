"""Registry, prefetch, text and time expressions on edge rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gainsay import schemas
from gainsay.functions import prefetch, registry
from gainsay.functions.text import (
    basename,
    contains_ignoring_case,
    html_escape,
    iso_timestamp,
    numeric_first,
    row_contains,
    strip,
)
from gainsay.functions.time import filetime_to_timestamp
from gainsay.schemas import severity_rank


@pytest.fixture(scope="module")
def each(spark):
    """Apply a column expression to one-column rows of the given type."""

    def run(values, expression, type_="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {type_}")
        return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def test_persistence_segments(each):
    paths = ["X\\Run", "x\\RUNONCE\\y", "X\\RunAs\\z", "Run", "X\\Runner", "a/run"]
    assert each(paths, registry.is_persistence_key) == [True, True, False, True, False, False]
    assert each(["A\\Go", "A\\Run"], lambda c: registry.is_persistence_key(c, ["GO"])) == [True, False]
    assert each(["A\\Run"], lambda c: registry.is_persistence_key(c, [])) == [False]


def test_exe_reference(each):
    data = ['"C:\\a b\\x.exe" -k', "x.EXE", "none", None, "a.exe\u00a0b.exe", "C:/q/w.exe.exe z"]
    expected = ["x.exe", "x.EXE", None, None, "a.exe", "w.exe.exe"]
    assert each(data, registry.exe_reference) == expected


def test_value_label(each):
    assert each(["", None, "n"], registry.value_label) == ["(default)", "(default)", "n"]


def test_under_key(each):
    paths = ["HKLM\\A", "hklm\\a\\b", "HKLM\\AB", "HKLM"]
    assert each(paths, lambda c: registry.under_key(c, "HKLM\\a")) == [True, True, False, False]


def test_values_split_into_records_and_failures(spark):
    keys = spark.sql("""
        SELECT 'c' AS case_id, 's' AS source_path, * FROM VALUES
          ('A', array('v1', 'v2'), CAST(NULL AS STRING)), ('B', CAST(array() AS ARRAY<STRING>), NULL),
          ('C', NULL, 'unreadable list') AS t(key_path, values, values_error)""")
    rows = registry.explode_values(keys).orderBy("key_path", "value").collect()
    assert [(r.key_path, r.value, r.reason) for r in rows] == [
        ("A", "v1", None), ("A", "v2", None), ("C", None, "unreadable list")
    ]


def test_hash_hex(each):
    values = [0x3EA9C6F2, 255, None, 2**32, -1]
    assert each(values, prefetch.hash_hex, "bigint") == ["3EA9C6F2", "000000FF", None, None, None]


def test_run_times(each):
    t = [datetime(2024, 1, d) for d in range(1, 10)]
    cases = [t, [t[0], t[1], None, t[3]], [], None, [None]]
    assert each(cases, prefetch.run_times, "array<timestamp>") == [t[:8], t[:2], [], [], []]


def test_filename_hash(spark):
    rows = [
        ("CALC.EXE-3EA9C6F2.pf", "3EA9C6F2"), ("CALC.EXE-3EA9C6F2.pf", "00000001"),
        ("d\\CALC.EXE-3ea9c6f2.pf", "3EA9C6F2"), ("foo.pf", "3EA9C6F2"),
        ("CALC.EXE-3EA9C6F2.PF", "00000001"), ("CALC.EXE-3EA9C6F2.pf", None),
    ]
    df = spark.createDataFrame(rows, "p string, h string")
    out = df.select(prefetch.filename_hash_matches(F.col("p"), F.col("h")).alias("x")).collect()
    assert [r.x for r in out] == [True, False, True, None, None, None]


def test_prefetch_fields_fail_alone(spark):
    row = ("c", "X.EXE-00000001.pf", "X.EXE", "zz", 30, 3, None, [None, "a"], [None, ("d", 255, None)])
    fields = list(schemas.PREFETCH_RAW.fields)
    schema = ", ".join(
        f"{f.name} {'string' if f.name == 'prefetch_hash' else f.dataType.simpleString()}" for f in fields
    )
    df = spark.createDataFrame([row], schema)
    out = prefetch.decode(df).first()
    assert out.prefetch_hash is None and out.filename_hash_matches is None
    assert (out.executable_name, out.run_count, out.last_run_times) == ("X.EXE", 3, [])
    assert out.referenced_filenames == ["a"] and out.volumes[0].serial_number == "000000FF"
    failures = prefetch.field_failures(prefetch.decode(df)).collect()
    assert [f.field_group for f in failures] == ["prefetch_hash"]


def test_filetime(each):
    ticks = [0, 2**63 - 1, 116444736000000000, 133500000000000010, 2650467743999999999, 5]
    assert each(ticks, lambda c: F.unix_micros(filetime_to_timestamp(c)), "bigint") == [
        None, None, 0, 1705526400000001, 253402300799999999, -11644473600000000
    ]


def test_text(each):
    assert each(["a\\b/c.pf", "x", ""], basename) == ["c.pf", "x", ""]
    assert each(["\u2003 a b\t", "\x1f", None], strip) == ["a b", "", None]
    assert each(["<a href=\"x\">&'"], html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]
    texts = ["run CALC.EXE", None, "a_c", "abc"]
    assert each(texts, lambda c: contains_ignoring_case(c, F.lit("a_c"))) == [False, False, True, False]
    assert each(["Ab", None], lambda c: row_contains([c, F.lit("Cd")], "bC")) == [True, False]


def test_iso(each):
    times = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60)]
    assert each(times, iso_timestamp, "timestamp") == [
        "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.000060+00:00"
    ]


def test_numeric_first_order(spark):
    df = spark.createDataFrame([(v,) for v in ("b", "10", "9", "a", "-1.5")], "v string")
    assert [r.v for r in df.orderBy(*numeric_first("v")).collect()] == ["-1.5", "9", "10", "a", "b"]


def test_severity_rank(each):
    assert each(["high", "info", "low", "medium", "x"], severity_rank) == [3, 0, 1, 2, None]
