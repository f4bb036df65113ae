"""Discovery, readers, rules, engine and reports on small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, functions as F
from slots import file_name, slot, standard

from gainsay import CaseTables, Rule, run, run_isolated, schemas
from gainsay.plans import engine, reports, rules
from gainsay.sources import case, discovery
from gainsay.sources.pieces import fixed_chunks

T = datetime(2024, 1, 1, 12)
WINDOW = timedelta(minutes=5)


def tables(spark, events=(), values=(), prefetch=(), mft=()):
    def table(rows, schema):
        if not rows:
            return None
        return spark.createDataFrame(
            [{"case_id": "c", "source_path": "src", **row} for row in rows], schema
        )

    return CaseTables.build(
        spark, table(events, schemas.EVENTS), table(values, schemas.REGISTRY_VALUES),
        table(prefetch, schemas.PREFETCH), table(mft, schemas.MFT),
    )


def event(number=1, event_id=4688, at=T, message="", **more):
    return dict(record_number=number, event_id=event_id, timestamp=at, message=message, raw_xml="", **more)


def program(name="calc.exe", times=(T,), **more):
    return dict(executable_name=name, last_run_times=list(times), **more)


def value(path="HKLM\\Run", text='"C:\\x.exe" -k', name="n", **data):
    return dict(key_path=path, name=name, data=dict(kind="text", s=text, i=None, b=None, l=None) | data)


# --- rule 1 ------------------------------------------------------------------------------------


def test_runs_without_events(spark):
    found = rules.prefetch_execution_without_event(
        tables(spark,
               [event(message="started CALC.EXE"), event(event_id=7, at=T + timedelta(hours=1), message="calc.exe")],
               prefetch=[program(times=[T + WINDOW, T + timedelta(hours=1)] + [T + timedelta(hours=1)]),
                         program(name=""), program(name=None)])
    ).collect()
    assert len(found) == 2
    assert found[0].evidence == ["ran at 2024-01-01T13:00:00+00:00", "recorded by src"]
    assert found[0].source_paths == ["src"] and found[0].severity == "medium"


def test_runs_are_not_judged_without_any_event(spark):
    none = tables(spark, prefetch=[program()])
    assert rules.prefetch_execution_without_event(none).count() == 0
    other_kind = tables(spark, [event(event_id=7)], prefetch=[program(), program()])
    assert rules.prefetch_execution_without_event(other_kind).count() == 2
    other_case = tables(spark, [event(case_id="d")], prefetch=[program()])
    assert rules.prefetch_execution_without_event(other_case).count() == 0


def test_parameters_of_the_window_rule(spark):
    t = tables(spark, [event(event_id=9, at=T + timedelta(hours=1), message="calc.exe")], prefetch=[program()])
    wide = rules.prefetch_execution_without_event(t, timedelta(hours=1), [9])
    narrow = rules.prefetch_execution_without_event(t, timedelta(minutes=59), [9])
    assert (wide.count(), narrow.count()) == (0, 1)


# --- rule 2 ------------------------------------------------------------------------------------


def test_startup_entries_without_execution(spark):
    values = [
        value(name=""), value(path="HKLM\\RunAs"), value(text="no program"),
        value(text=None, kind="list", l=["x.exe"]), value(text="SEEN.exe"), value(text="zero.exe"),
    ]
    prefetch = [program("seen.EXE", run_count=2), program("zero.exe", run_count=0), program("x.exe", run_count=None)]
    found = rules.persistence_without_execution(tables(spark, values=values, prefetch=prefetch))
    rows = found.orderBy("details").collect()
    assert [r.details for r in rows] == [
        '{"key_path":"HKLM\\\\Run","value":"(default)","exe_name":"x.exe"}',
        '{"key_path":"HKLM\\\\Run","value":"n","exe_name":"zero.exe"}',
    ]
    assert rules.persistence_without_execution(tables(spark, values=values)).count() == 0


# --- rules 3 to 5 --------------------------------------------------------------------------------


def test_only_a_false_hash_comparison_is_a_mismatch(spark):
    t = tables(spark, prefetch=[program(filename_hash_matches=m, prefetch_hash="0000000A") for m in (True, False, None)])
    found = rules.prefetch_hash_mismatch(t).collect()
    assert len(found) == 1 and found[0].severity == "high"
    assert found[0].evidence == ["hash inside 0000000A", "file name src"]


@pytest.mark.parametrize(
    "numbers, severities",
    [([1, 2, 3], []), ([1, 12], ["medium"]), ([1, 11], ["info"]), ([1, 1, 2], []), ([1, 20, 22], ["info", "medium"])],
)
def test_gap_findings(spark, numbers, severities):
    found = rules.record_number_gap(tables(spark, [event(number=n) for n in numbers])).collect()
    assert sorted(r.severity for r in found) == severities


def test_gap_evidence(spark):
    rows = [event(number=2 * n) for n in range(13)] + [event(number=n, source_path="b") for n in (1, 100)]
    found = rules.record_number_gap(tables(spark, rows)).orderBy("severity").collect()
    assert found[0].evidence[0] == "absent 1 to 1, 1 in all"
    assert found[0].evidence[10:] == ["2 further gaps"]
    assert found[0].details == '{"gap_count":12,"total_missing":12,"largest":1}'
    assert found[1].source_paths == ["b"] and found[1].evidence[0] == "absent 2 to 99"


def test_timestomping_from_raw_slots(spark, tmp_path):
    old, made = datetime(2011, 3, 1), datetime(2024, 6, 20)
    (tmp_path / "$MFT").write_bytes(slot(standard(old, old, made, old), file_name("u.exe", 1, made), flags=0))
    t = case.build_context(spark, mft_paths=[str(tmp_path / "$MFT")])
    found = rules.mft_timestomping(t).collect()
    assert [r.evidence for r in found] == [["set back: creation_time, modification_time, access_time"]]


# --- engine --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def full_case(spark):
    return tables(
        spark,
        [event(number=n, message="x") for n in (1, 3, 50)],
        [value()],
        [program(filename_hash_matches=False, prefetch_hash="1", run_count=1)],
        [dict(record_number=4, likely_timestomped=True, timestamp_anomalies=["creation_time"])],
    )


def test_run_orders_by_severity_then_rule(full_case):
    names = [(r.severity, r.rule_name) for r in run(full_case).collect()]
    assert names == [
        ("high", rules.HASH_MISMATCH), ("high", rules.TIMESTOMPING), ("medium", rules.PREFETCH_WITHOUT_EVENT),
        ("medium", rules.PERSISTENCE_WITHOUT_EXECUTION), ("medium", rules.RECORD_GAP), ("info", rules.RECORD_GAP),
    ]
    by_rule = [r.rule_name for r in engine.by_rule(run(full_case, ordered=False)).collect()]
    assert by_rule == sorted(by_rule)


def test_order_does_not_depend_on_partitions(spark, full_case):
    shuffled = CaseTables(*[df.repartition(5) for df in full_case.named().values()])
    assert run(shuffled).collect() == run(full_case).collect()


def test_no_rules_and_custom_rules(spark, full_case):
    assert run(full_case, []).count() == 0

    def cleared(t):
        return rules.findings(
            t.events.filter("record_number = 50"), "custom", "low", description=F.lit("d"),
            evidence=[F.lit("e")], details={"n": F.col("record_number")}, ordinal=F.lit(0),
        )

    assert [r.rule_name for r in run(full_case, [Rule("custom", cleared)]).collect()] == ["custom"]
    with pytest.raises(ValueError):
        run(full_case, [Rule("bad shape", lambda t: t.events)])


def test_a_failing_rule_leaves_the_others(full_case):
    def late(t):
        found = rules.mft_timestomping(t)
        return found.withColumn("ordinal", F.raise_error(F.lit("boom")).cast("bigint"))

    def early(t):
        raise RuntimeError("no such thing")

    found, failed = run_isolated(full_case, [Rule("late", late), Rule("early", early), *engine.DEFAULT_RULES])
    assert found.count() == 6
    assert {r.rule_name for r in failed.collect()} == {"late", "early"}


def test_bad_files_drop_out_as_a_whole(spark, full_case):
    bad = spark.createDataFrame([("c", "src", "broken")], schemas.BAD_FILES)
    assert {r.row_count for r in full_case.without(bad).row_counts().collect()} == {0}
    full_case.create_views()
    assert spark.sql("SELECT count(*) FROM events").first()[0] == 3


# --- files and readers -------------------------------------------------------------------------


def test_classification(spark):
    names = ["A.EVTX", "x.pf", "$MFT", "C_MFT", "NTUSER.DAT", "system", "Amcache.hve", "mft.txt", ".evtx", "a/b\\SAM"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r.c for r in df.select(discovery.classify(F.col("path")).alias("c")).collect()] == [
        "evtx", "prefetch", "mft", "mft", "registry", "registry", None, None, None, "registry"
    ]


def test_discovery(spark, tmp_path):
    for name in ("a/Security.evtx", "a/b/x.pf", "a/b/_MFT", "SYSTEM", "notes.txt", ".hidden/.evtx"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    (tmp_path / "empty.evtx").write_bytes(b"")
    (tmp_path / "a" / "link").symlink_to(tmp_path / "gone")
    files = discovery.discover(spark, str(tmp_path), "c")
    assert files.rdd.getNumPartitions() >= 3
    assert discovery.discover(spark, tmp_path.as_uri()).count() == files.count() == 7
    with pytest.raises(Exception, match="no such folder"):
        discovery.discover(spark, str(tmp_path / "nowhere")).count()
    assert discovery.summary(files).first().asDict() == {
        "evtx_count": 2, "registry_count": 1, "prefetch_count": 1, "mft_count": 1, "total_count": 5, "unclassified_count": 2,
    }
    assert [r.path.rsplit("/", 1)[1] for r in discovery.paths_of(files, "evtx").collect()] == ["Security.evtx", "empty.evtx"]
    bad = discovery.invalid_files(files, F.col("category")).collect()
    assert [(r.source_path.rsplit("/", 1)[1], r.reason) for r in bad] == [("empty.evtx", "empty file")]
    asked = files.select("case_id", F.col("path").alias("source_path")).limit(1).unionByName(
        spark.createDataFrame([("c", "gone")], "case_id string, source_path string"))
    assert [r.source_path for r in discovery.missing_files(asked, files).collect()] == ["gone"]


def test_landing_files_become_tables(spark, tmp_path):
    from gainsay.functions.events import EVENT_NAMESPACE

    xml = f'<Event xmlns="{EVENT_NAMESPACE}"><System><EventID>1</EventID></System></Event>'
    events = spark.createDataFrame([(1, xml), (2, "<broken")], "record_number bigint, raw_xml string")
    events.write.parquet(str(tmp_path / "ev"))
    spark.createDataFrame([("c", "p.pf", "A.EXE", 1, 30, 1, [T], [], [])], schemas.PREFETCH_RAW).write.parquet(str(tmp_path / "pf"))
    spark.createDataFrame(
        [Row(key_path="A\\Run", name=None, data=dict(kind="text", s="b.exe"), raw_data_bytes=b"\xab")],
        "key_path string, name string, data struct<kind:string,s:string>, raw_data_bytes binary",
    ).write.parquet(str(tmp_path / "reg"))
    paths = [str(tmp_path / "ev")]
    t = case.build_context(spark, paths, prefetch_paths=[str(tmp_path / "pf")])
    assert {r.table_name: r.row_count for r in t.row_counts().collect()} == {
        "events": 1, "registry_values": 0, "prefetch": 1, "mft": 0,
    }
    assert t.events.first().source_path.endswith(".parquet") and t.events.first().case_id == "case"
    assert t.prefetch.first().case_id == "c"
    assert case.build_context(spark, paths * 2).events.count() == 2
    values = case.read_rows(spark, str(tmp_path / "reg"))
    assert values.columns[-2:] == ["source_path", "case_id"]


def test_file_pattern_keeps_to_the_folder(spark, tmp_path):
    for name in ("a.jsonl", "b.txt", "sub/c.jsonl"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text('{"record_number": 1}\n')
    rows = case.read_rows(spark, str(tmp_path), format="json", pattern="*.jsonl", schema=schemas.EVENT_XML)
    assert [r.source_path.rsplit("/", 1)[1] for r in rows.collect()] == ["a.jsonl"]


def test_scoped_values_and_missing_root(spark):
    rows = spark.createDataFrame(
        [("c", "h1", "A\\B"), ("c", "h1", "A\\C"), ("c", "h2", "Z")], "case_id string, source_path string, key_path string")
    bad = case.files_without_root(rows, "a\\b").collect()
    assert [(r.source_path, r.reason) for r in bad] == [("h2", "root key not found")]


def test_own_decoder(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "x.bin").write_bytes(b"abc")

    def decoder(batches):
        for batch in batches:
            sizes = [len(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("source_path"), pa.array(sizes, pa.int64())], ["source_path", "n"])

    out = case.decode_with(spark, str(tmp_path), decoder, "source_path string, n bigint").first()
    assert out.n == 3 and out.source_path.endswith("x.bin")


# --- reports -------------------------------------------------------------------------------------


def test_event_report_files(spark, tmp_path):
    t = tables(spark, [event(number=n, message="<m>", level=2, channel=None) for n in (2, 1)])
    failures = spark.createDataFrame([("c", "src", 3, "bad <x>")], "case_id string, source_path string, record_number bigint, reason string")
    reports.write_event_report(reports.event_report(t.events, failures), str(tmp_path / "r"))
    rows = [r.value for r in spark.read.text(str(tmp_path / "r" / "case_id=c" / "source_path=src" / "section=1-records")).collect()]
    assert rows[0] == (
        '<tr data-level="2"><td>1</td><td>4688</td><td>2024-01-01T12:00:00+00:00</td><td></td><td></td><td></td>'
        '<td>2</td><td>&lt;m&gt;</td></tr>'
    )
    bad = [r.value for r in spark.read.text(str(tmp_path / "r" / "case_id=c" / "source_path=src" / "section=2-failures")).collect()]
    assert bad == ["<tr data-failed><td>3</td><td>bad &lt;x&gt;</td></tr>"]


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_findings_sinks(spark, full_case, tmp_path, format):
    reports.write_findings(run(full_case), str(tmp_path / format), format)
    back = spark.read.format(format).options(header="true", multiLine=format == "csv", escape='"').load(str(tmp_path / format))
    assert back.count() == 6


def test_listings(spark, full_case):
    assert reports.prefetch_listing(full_case.prefetch).first().run_time == T
    assert reports.prefetch_volumes(full_case.prefetch).count() == 1
    assert reports.prefetch_lines(full_case.prefetch).first().file_name == "src"
    assert reports.prefetch_summary(full_case.prefetch).first().mismatch_count == 1
    failures = spark.createDataFrame([("c", "src", 1, "bad")], "case_id string, source_path string, record_number bigint, reason string")
    assert reports.mft_summary(full_case.mft, failures).first().asDict() == {
        "record_count": 1, "timestomped_count": 1, "directory_count": 0, "deleted_count": 0, "failure_count": 1,
    }
    summary = reports.event_source_summary(full_case.events).first()
    assert (summary.record_count, summary.first_record_number) == (3, 1)
    assert "[HIGH] " in run(full_case).select(reports.finding_detail().alias("d")).first().d
    empty = run(full_case, [])
    assert [r.value for r in reports.findings_report(empty).collect()] == [reports.NOTHING_FOUND]


# --- a folder to findings, in any session --------------------------------------------------------


def test_findings_do_not_depend_on_the_sessions_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        events = spark.sql(
            "SELECT 'c' case_id, 'log' source_path, 1L record_number, 4688L event_id, 'calc.exe' message, '' raw_xml,"
            " TIMESTAMP_NTZ'2024-03-10 02:30:00' timestamp"
        )
        runs = spark.sql(
            "SELECT 'c' case_id, 'pf' source_path, 'calc.exe' executable_name,"
            " array(TIMESTAMP_NTZ'2024-03-10 02:34:59', TIMESTAMP_NTZ'2024-03-10 02:35:01') last_run_times"
        )
        found = rules.prefetch_execution_without_event(CaseTables.build(spark, events=events, prefetch=runs)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.evidence[0] for r in found] == ["ran at 2024-03-10T02:35:01+00:00"]


@pytest.mark.parametrize("splitter", [(), (fixed_chunks(1 << 20),)])
def test_a_folder_becomes_a_case_without_its_bad_files(spark, tmp_path, splitter):
    from gainsay.functions.events import EVENT_NAMESPACE

    def decoder(batches):
        import pyarrow as pa

        for batch in batches:
            for i, content in enumerate(batch.column("content").to_pylist()):
                rows = [x for x in content.decode().split("\n") if x]
                yield pa.RecordBatch.from_pydict({
                    "case_id": [batch.column("case_id")[i].as_py()] * len(rows),
                    "source_path": [batch.column("source_path")[i].as_py()] * len(rows),
                    "record_number": list(range(1, len(rows) + 1)), "raw_xml": rows,
                })

    folder = tmp_path / "my case+50%"
    (folder / "logs").mkdir(parents=True)
    good = f'<Event xmlns="{EVENT_NAMESPACE}"><System><EventID>4688</EventID></System></Event>'
    (folder / "logs" / "a b.evtx").write_text(f"{good}\n{good}\n<Event>broken\n")
    (folder / "logs" / "empty.evtx").write_text("")
    (folder / "$MFT").write_bytes(slot(file_name("a", 1, T)) + slot(signature=b"BAAD"))
    (folder / "SYSTEM").write_bytes(b"hive")
    (folder / "notes.txt").write_text("not an artifact")
    schema = "case_id string, source_path string, record_number bigint, raw_xml string"
    by_folder = F.when(F.contains("source_path", F.lit("my case+50%")), "mine").otherwise("other")
    made = case.open_folder(spark, str(folder), case_id=by_folder, decoders={"evtx": (decoder, schema, *splitter)})
    assert {(r.case_id, r.source_path, r.record_number) for r in made.tables.events.collect()} == {
        ("mine", f"{folder}/logs/a b.evtx", 1), ("mine", f"{folder}/logs/a b.evtx", 2)
    }
    assert [(r.case_id, r.source_path) for r in made.tables.mft.collect()] == [("mine", f"{folder}/$MFT")]
    assert {(r.stage, r.place, r.reason) for r in made.failures.collect()} == {
        ("events", "3", "malformed XML"), ("mft", "1", "marked corrupt by the file system")
    }
    assert {(r.source_path, r.reason) for r in made.bad_files.collect()} == {
        (f"{folder}/logs/empty.evtx", "empty file"), (f"{folder}/SYSTEM", "no decoder for this kind")
    }
    bad = made.tables.events.select("case_id", "source_path").distinct()
    assert made.tables.without(bad).events.count() == 0
    assert run(made.tables).count() == 0


def test_landing_rows_with_numbers_that_do_not_fit(spark, tmp_path):
    spark.sql(
        "SELECT 'c' case_id, 'A.EXE-00000001.pf' source_path, 'A.EXE' executable_filename, '1' prefetch_hash,"
        " 1099511627776L format_version, 'x' run_count UNION ALL"
        " SELECT 'c', 'B.EXE-00000002.pf', 'B.EXE', 'junk', 30L, '5'"
    ).write.parquet(str(tmp_path / "pf"))
    made = case.ingest(spark, prefetch_paths=[str(tmp_path / "pf")])
    rows = {r.executable_name: r for r in made.tables.prefetch.collect()}
    assert (rows["A.EXE"].prefetch_hash, rows["A.EXE"].format_version, rows["A.EXE"].run_count) == ("00000001", None, None)
    assert (rows["B.EXE"].prefetch_hash, rows["B.EXE"].format_version, rows["B.EXE"].run_count) == (None, 30, 5)
    assert {(r.source_path[:1], r.place) for r in made.failures.collect()} == {
        ("A", "format_version"), ("A", "run_count"), ("B", "prefetch_hash")
    }


def test_hives_without_the_root_key_are_left_out(spark, tmp_path):
    spark.sql(
        "SELECT 'c' case_id, explode(array('h1', 'h2')) source_path, 'K' key_path, 'n' name"
    ).selectExpr("case_id", "source_path", "IF(source_path = 'h1', 'Root\\\\Run', 'Else') key_path", "name").write.parquet(str(tmp_path / "r"))
    made = case.ingest(spark, registry_paths=[str(tmp_path / "r")], root_key="root")
    assert [r.source_path for r in made.tables.registry_values.collect()] == ["h1"]
    assert [(r.source_path, r.reason) for r in made.bad_files.collect()] == [("h2", "root key not found")]
