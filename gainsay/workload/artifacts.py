"""Queries over single artifact kinds: event XML, registry, prefetch, file records, files."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gainsay.functions import prefetch, registry
from gainsay.functions.mft import preferred_name, timestamp_anomalies
from gainsay.functions.text import basename, html_escape, numeric_first, row_contains
from gainsay.functions.time import filetime_to_timestamp, timestamp_to_filetime, utc
from gainsay.operators import rows as row_ops
from gainsay.operators.slots import slot_mismatches
from gainsay.operators.tree import key_paths, with_subkey_counts
from gainsay.plans import reports, rules
from gainsay.session import use_checkpoint_dir
from gainsay.sources import case, discovery
from gainsay.sources.files import open_uri
from gainsay.workload import standins
from gainsay.workload.catalog import (
    EVENTS_SQL,
    MFT_SQL,
    PARTS_RUN_SQL,
    PREFETCH_FILES_SQL,
    REGISTRY_SQL,
    SHIPMENTS_SQL,
    escape_sql,
    iso_sql,
    query,
)

def _text(column: str, name: str | None = None) -> Column:
    """Nullable values as text, timestamps by their microseconds; NULL looks the same everywhere."""
    value = F.unix_micros(column) if name else F.col(column)
    return value.cast("string").alias(name or column)


# --- event XML ---------------------------------------------------------------------------------


@query("""
SELECT 'case-' || (user_id % 4) AS case_id, event_id AS record_number,
       CASE WHEN d = 4 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS event_id,
       CASE WHEN d = 5 THEN NULL ELSE CAST(epoch_us(ts) AS VARCHAR) END AS micros,
       CASE WHEN d = 6 THEN NULL ELSE event_type END AS provider_name,
       CASE WHEN shape = 8 THEN '' ELSE 'HOST-' || user_id END AS computer_name, CAST(NULL AS VARCHAR) AS channel,
       CASE WHEN shape IN (2, 5) THEN NULL ELSE '4' END AS level,
       CASE WHEN d IN (7, 9) OR shape IN (6, 7) THEN NULL WHEN d = 8 THEN props
            ELSE props || ' | ' || event_type END AS message
FROM (SELECT *, event_id % 10 AS d, CASE WHEN event_id % 10 IN (0, 4, 5) THEN (event_id // 10) % 9 ELSE -1 END AS shape
      FROM events) WHERE d NOT IN (1, 2, 3)
""")
def event_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = case.events_from_xml(standins.event_xml(spark, sf_dir))
    return records.select(
        "case_id", "record_number", _text("event_id"), _text("timestamp", "micros"),
        "provider_name", "computer_name", "channel", _text("level"), "message",
    )


@query("""
SELECT 'xml/user-' || user_id AS source_path, event_id AS record_number,
       CASE WHEN event_id % 10 = 2 THEN 'no System element' ELSE 'malformed XML' END AS reason
FROM events WHERE event_id % 10 IN (1, 2, 3)
""")
def event_xml_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures = case.events_from_xml(standins.event_xml(spark, sf_dir))
    return failures.select("source_path", "record_number", "reason")


def _event_row_sql() -> str:
    cells = ["CAST(record_number AS VARCHAR)", "CAST(event_id AS VARCHAR)", iso_sql("ts"),
             "provider_name", "computer_name", "'Security'", "CAST(level AS VARCHAR)", "message"]
    joined = " || ".join(f"'<td>' || {escape_sql(c)} || '</td>'" for c in cells)
    return f"'<tr data-level=\"' || level || '\">' || {joined} || '</tr>'"


@query(f"""
SELECT case_id, source_path, record_number, {_event_row_sql()} AS html FROM ({EVENTS_SQL})
""")
def event_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.event_report(standins.events(spark, sf_dir))
    return report.select(
        "case_id", "source_path", F.col("place").alias("record_number"), F.col("value").alias("html")
    )


@query(f"""
SELECT case_id, 'logs%2F' || host || '.evtx' AS report, 0 AS part, count(*) AS line_count,
       md5(string_agg(html, chr(10) ORDER BY record_number) || chr(10)) AS content_md5
FROM (SELECT case_id, computer_name AS host, record_number, {_event_row_sql()} AS html FROM ({EVENTS_SQL}))
GROUP BY case_id, host
""")
def event_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every log written as an ordered file, and the files read back as they are."""
    logs = standins.events(spark, sf_dir).withColumn("source_path", F.concat(F.lit("logs/"), "computer_name", F.lit(".evtx")))
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    reports.write_report_files(reports.event_report(logs), folder, whole=True)
    # Files are read as streams: one may be as long as a log.
    paths = spark.read.format("binaryFile").load(folder).select(F.col("case").cast("string").alias("case_id"), "path")
    digests = paths.mapInArrow(_file_digests(folder), "case_id string, path string, line_count bigint, content_md5 string")
    named = r"report=([^/]*)\.(\d{5})\.html$"
    return digests.select(
        "case_id", F.regexp_extract("path", named, 1).alias("report"), F.regexp_extract("path", named, 2).cast("int").alias("part"),
        "line_count", "content_md5",
    )


def _file_digests(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_uri(folder)
        for batch in batches:
            lines, digests = [], []
            for path in batch.column("path").to_pylist():
                count, digest = 0, hashlib.md5()
                with store.open_input_stream("/".join([root, *path.rsplit("/", 2)[1:]])) as file:
                    while some := file.read(1 << 22):
                        count += some.count(b"\n")
                        digest.update(some)
                lines.append(count)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lines, pa.int64()), pa.array(digests, pa.string())],
                names=["case_id", "path", "line_count", "content_md5"],
            )

    return run


@query(f"""
SELECT count(DISTINCT source_path) AS file_count, count(*) AS record_count FROM ({EVENTS_SQL})
""")
def event_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.event_report_totals(standins.events(spark, sf_dir))


@query(f"""
SELECT case_id, source_path, count(*) AS record_count, min(record_number) AS first_record_number,
       arg_min(event_id, record_number) AS first_event_id,
       arg_min(provider_name, record_number) AS first_provider_name,
       arg_min(epoch_us(ts), record_number) AS first_micros
FROM ({EVENTS_SQL}) GROUP BY ALL
""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.event_source_summary(standins.events(spark, sf_dir))
    return summary.withColumn("first_micros", F.unix_micros("first_timestamp")).drop("first_timestamp")


@query(f"""
SELECT record_number, event_id, epoch_us(ts) AS micros, provider_name, 'Security' AS channel,
       level, computer_name
FROM ({EVENTS_SQL})
""")
def event_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = reports.event_listing(standins.events(spark, sf_dir))
    return listing.withColumn("micros", F.unix_micros("timestamp")).drop("timestamp")


@query(f"""
SELECT case_id, source_path, record_number FROM ({EVENTS_SQL})
WHERE source_path NOT IN (SELECT 'logs/user-' || user_id || '.evtx' FROM events WHERE event_id % 97 = 0)
""")
def quarantined_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unreadable record spoils its whole file."""
    records = standins.events(spark, sf_dir)
    bad = records.filter(F.col("record_number") % 97 == 0).select(
        "case_id", "source_path", F.lit("unreadable").alias("reason")
    )
    return row_ops.without_bad_files(records, bad).select("case_id", "source_path", "record_number")


@query("""
SELECT doc_id FROM documents
WHERE contains(lower(concat_ws('', CAST(doc_id AS VARCHAR), text, lang, source)), 'the 1')
   OR contains(lower(concat_ws('', CAST(doc_id AS VARCHAR), text, lang, source)), 'license')
""")
def row_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "text", "lang", "source"]
    rows = standins.read(spark, sf_dir, "documents")
    return rows.filter(row_contains(columns, "The 1") | row_contains(columns, "LICENSE")).select("doc_id")


@query(f"SELECT page_id, {escape_sql('html')} AS escaped FROM pages")
def html_escaped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.read(spark, sf_dir, "pages").select(
        "page_id", html_escape(F.col("html")).alias("escaped")
    )


# --- registry ----------------------------------------------------------------------------------


@query(f"SELECT p_partkey, key_path FROM ({REGISTRY_SQL}) WHERE p_size % 2 = 0")
def persistence_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = standins.registry_values(spark, sf_dir)
    return values.filter(registry.is_persistence_key(F.col("key_path"))).select("p_partkey", "key_path")


@query(f"""
SELECT p_partkey, CASE WHEN s IS NULL THEN NULL ELSE p_brand || '.EXE' END AS exe_name FROM ({REGISTRY_SQL})
""")
def exe_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = standins.registry_values(spark, sf_dir)
    return values.select("p_partkey", registry.exe_reference(F.col("data.s")).alias("exe_name"))


@query(f"""
SELECT p_partkey, p_brand || '.EXE' AS exe_name FROM ({REGISTRY_SQL}) r
WHERE p_size % 2 = 0 AND s IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM ({PARTS_RUN_SQL}) x WHERE x.exe_key = lower(r.p_brand || '.exe'))
""")
def persistence_without_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all cases at once: the names are compared without their case."""
    entries = rules.persistence_entries(
        standins.registry_values(spark, sf_dir), registry.PERSISTENCE_SEGMENTS
    ).withColumn("exe_key", F.lower("exe_name"))
    seen = rules.executed_names(standins.executed_parts(spark, sf_dir))
    return row_ops.not_seen(entries, seen, ["exe_key"]).select("p_partkey", "exe_name")


@query(f"SELECT DISTINCT case_id, exe_key FROM ({PARTS_RUN_SQL})")
def executed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.executed_names(standins.executed_parts(spark, sf_dir)).distinct()


@query(f"""
SELECT case_id, source_path, key_path, CASE WHEN name = '' THEN '(default)' ELSE name END AS name,
       'RegSZ' AS value_type_str,
       CASE WHEN s IS NULL
            THEN '{{"kind":"list","l":["\\"C:\\\\bin\\\\' || p_brand || '.EXE\\" -k"]}}'
            ELSE '{{"kind":"text","s":"\\"C:\\\\bin\\\\' || p_brand || '.EXE\\" -k"}}' END AS data
FROM ({REGISTRY_SQL})
""")
def value_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_listing(standins.registry_values(spark, sf_dir))


@query(f"""
SELECT key_path, name, lower(hex(p_brand)) AS raw_data FROM ({REGISTRY_SQL})
WHERE starts_with(lower(key_path), 'hklm\\economy\\') OR lower(key_path) = 'hklm\\economy'
""")
def registry_values_under_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, _ = case.values_from_rows(standins.registry_values(spark, sf_dir), root="hklm\\Economy")
    return values.select("key_path", "name", "raw_data")


_KEY_CELLS_SQL = """
SELECT CAST(r_regionkey AS BIGINT) AS key_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name, false AS bad FROM region
UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name, n_nationkey % 11 = 3 FROM nation
UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name, false FROM customer
"""


@query(f"""
WITH RECURSIVE cells AS ({_KEY_CELLS_SQL}),
paths AS (
  SELECT key_id, name AS path, 1 AS depth FROM cells WHERE parent_id IS NULL AND NOT bad
  UNION ALL
  SELECT c.key_id, p.path || '\\' || c.name, p.depth + 1 FROM paths p JOIN cells c ON c.parent_id = p.key_id
  WHERE NOT c.bad)
SELECT key_id, path, depth FROM paths
""")
def key_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_paths(standins.key_cells(spark, sf_dir)).select("key_id", "path", "depth")


@query(f"""
WITH cells AS ({_KEY_CELLS_SQL})
SELECT c.key_id, c.name, (SELECT count(*) FROM cells k WHERE k.parent_id = c.key_id) AS subkey_count FROM cells c
""")
def subkey_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_subkey_counts(standins.key_cells(spark, sf_dir)).select("key_id", "name", "subkey_count")


# --- prefetch ----------------------------------------------------------------------------------


@query(f"SELECT c_custkey, file_name, CAST(filename_hash_matches AS VARCHAR) AS matches FROM ({PREFETCH_FILES_SQL})")
def filename_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.prefetch_files(spark, sf_dir).select(
        F.conv("prefetch_hash", 16, 10).cast("bigint").alias("c_custkey"),
        basename(F.col("source_path")).alias("file_name"),
        F.col("filename_hash_matches").cast("string").alias("matches"),
    )


@query("SELECT c_custkey, upper(printf('%08x', c_custkey)) AS hash FROM customer")
def hash_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.read(spark, sf_dir, "customer").select(
        "c_custkey", prefetch.hash_hex(F.col("c_custkey")).alias("hash")
    )


@query(f"""
SELECT count(*) AS file_count, count(*) FILTER (filename_hash_matches = false) AS mismatch_count
FROM ({PREFETCH_FILES_SQL})
""")
def hash_mismatch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.prefetch_summary(standins.prefetch_files(spark, sf_dir))


_SLOTS_SQL = """
SELECT o_custkey, (o_orderkey // 45) AS file, o_orderdate, o_orderkey % 13 = 0 AS missing,
       row_number() OVER (PARTITION BY o_custkey, o_orderkey // 45 ORDER BY o_orderkey) AS place
FROM (SELECT o_orderkey % 5 AS o_custkey, o_orderkey, o_orderdate FROM orders)
"""


@query(f"""
SELECT o_custkey, file, CAST(place - 1 AS INTEGER) AS run_index, epoch_us(o_orderdate) AS micros
FROM (SELECT *, max(CAST(missing AS INTEGER)) OVER (PARTITION BY o_custkey, file ORDER BY place) AS cut
      FROM ({_SLOTS_SQL}))
WHERE cut = 0 AND place <= 8
""")
def run_times_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as run-time slots, dealt to files of up to nine; some slots are empty."""
    key = F.col("o_orderkey")
    slots = (
        standins.read(spark, sf_dir, "orders")
        .select(
            (key % 5).alias("o_custkey"),
            F.floor(key / 45).alias("file"),
            F.struct(key, F.when(key % 13 != 0, utc(F.col("o_orderdate"))).alias("slot")).alias("slot"),
        )
        .groupBy("o_custkey", "file")
        .agg(F.array_sort(F.collect_list("slot")).alias("slots"))
        .select("o_custkey", "file", prefetch.run_times(F.col("slots.slot")).alias("last_run_times"))
    )
    return prefetch.explode_run_times(slots).select(
        "o_custkey", "file", "run_index", F.unix_micros("run_time").alias("micros")
    )


def _run_slots(key: Column) -> Column:
    """Up to nine run times; one in the middle may be missing."""
    times = F.transform(
        F.sequence(F.lit(0), (key % 10 - 1).cast("int")),
        lambda i: F.when(i != key % 13, F.timestamp_seconds(F.lit(1_700_000_000) + key * 60 + i)),
    )
    return F.when(key % 10 > 0, times).otherwise(F.array().cast("array<timestamp>"))


def _raw_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as decoder output: numbers as text, some of them unusable, lists with holes."""
    key = F.col("c_custkey")
    text = key.cast("string")
    volume = F.struct(
        F.col("c_mktsegment").alias("device_path"), key.alias("serial_number"),
        F.lit(None).cast("timestamp").alias("creation_time"),
    )
    return standins.read(spark, sf_dir, "customer").select(
        standins.case_of("c_custkey").alias("case_id"),
        F.concat(F.col("c_name"), F.lit("-"), prefetch.hash_hex(key), F.lit(".pf")).alias("source_path"),
        F.col("c_name").alias("executable_filename"),
        F.when(key % 5 == 0, "4294967296").when(key % 5 == 1, "junk").otherwise(text).alias("prefetch_hash"),
        F.when(key % 6 == 0, "v30").otherwise("30").alias("format_version"),
        F.when(key % 7 == 0, None).otherwise(text).alias("run_count"),
        _run_slots(key).alias("last_run_times"),
        F.array(F.col("c_name"), F.lit(None), F.col("c_mktsegment")).alias("filenames"),
        F.array(F.when(key % 2 == 0, volume), volume).alias("volumes"),
    )


@query("""
SELECT c_name AS executable_name,
       CASE WHEN c_custkey % 5 > 1 THEN upper(printf('%08x', c_custkey)) END AS prefetch_hash,
       CASE WHEN c_custkey % 5 > 1 THEN 'true' END AS matches,
       CASE WHEN c_custkey % 6 > 0 THEN '30' END AS format_version,
       CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey AS VARCHAR) END AS run_count,
       c_name || ',' || c_mktsegment AS filenames,
       CAST(CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS volume_count,
       upper(printf('%08x', c_custkey)) AS serial
FROM customer
""")
def prefetch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = case.prefetch_from_rows(_raw_prefetch(spark, sf_dir))
    return records.select(
        "executable_name", "prefetch_hash",
        F.col("filename_hash_matches").cast("string").alias("matches"),
        _text("format_version"), _text("run_count"), F.array_join("referenced_filenames", ",").alias("filenames"),
        F.size("volumes").alias("volume_count"),
        F.get("volumes", F.lit(0))["serial_number"].alias("serial"),
    )


@query("""
SELECT c_name || '-' || upper(printf('%08x', c_custkey)) || '.pf' AS source_path, 'prefetch_hash' AS field_group,
       'not a 32-bit number' AS reason
FROM customer WHERE c_custkey % 5 < 2
UNION ALL
SELECT c_name || '-' || upper(printf('%08x', c_custkey)) || '.pf', 'format_version', 'not a number'
FROM customer WHERE c_custkey % 6 = 0
""")
def prefetch_field_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures = case.prefetch_from_rows(_raw_prefetch(spark, sf_dir))
    return failures.select("source_path", "field_group", "reason")


# --- file records ------------------------------------------------------------------------------


@query(f"""
SELECT concat_ws(',', CASE WHEN l_shipdate < ordered - INTERVAL 1 SECOND THEN 'ship' END,
                 CASE WHEN l_shipdate + INTERVAL 30 DAY < ordered - INTERVAL 1 SECOND THEN 'late' END) AS anomalies,
       l_linestatus, count(*) AS lines
FROM ({SHIPMENTS_SQL}) GROUP BY ALL
""")
def shipment_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = {"ship": F.col("shipped"), "late": F.col("shipped") + F.expr("INTERVAL '30' DAY")}
    found = timestamp_anomalies(times, F.col("ordered"))
    return (
        standins.shipments(spark, sf_dir)
        .groupBy(F.array_join(found, ",").alias("anomalies"), "l_linestatus")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(f"""
SELECT case_id, source_path, record_number, filename, anomalies FROM ({MFT_SQL}) WHERE anomalies <> ''
""")
def timestamp_anomalies_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timestomped(standins.mft(spark, sf_dir))


@query(f"""
SELECT count(*) AS record_count, count(*) FILTER (anomalies <> '') AS timestomped_count,
       count(*) FILTER (is_directory) AS directory_count,
       count(*) FILTER (NOT is_allocated) AS deleted_count
FROM ({MFT_SQL})
""")
def mft_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.mft_summary(standins.mft(spark, sf_dir))


@query("""
SELECT event_id, (epoch_us(ts) + 11644473600000000) * 10 + 7 AS ticks, epoch_us(ts) AS micros FROM events
""")
def filetime_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.read(spark, sf_dir, "events").select(
        "event_id", (timestamp_to_filetime(utc(F.col("ts"))) + 7).alias("ticks")
    )
    return rows.withColumn("micros", F.unix_micros(filetime_to_timestamp(F.col("ticks"))))


@query("""
SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
           CASE l_returnflag WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 4 END,
           l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1
""")
def preferred_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as names: the return flag is the namespace, the line number the order met."""
    space = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 3).otherwise(9)
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    names = F.array_sort(F.collect_list(F.struct(*fields, space.alias("namespace"))))
    return (
        standins.read(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(names.alias("names"))
        .select("l_orderkey", preferred_name(F.col("names")).alias("best"))
        .select("l_orderkey", *[F.col(f"best.{f}").alias(f) for f in fields])
    )


@query("""
SELECT record_number, record_number AS embedded_record_number, is_allocated, is_directory,
       CASE WHEN k <> 7 THEN 'ordre-é-' || record_number END AS filename,
       CASE WHEN k <> 7 THEN CAST(o_custkey AS VARCHAR) END AS parent_record_number,
       CASE WHEN k <> 6 THEN CAST(us - (o_custkey % 3) * 86400000000 AS VARCHAR) END AS created,
       CASE WHEN k NOT IN (5, 6) THEN CAST(us - 1000000 AS VARCHAR) END AS changed,
       CASE WHEN k <> 7 THEN CAST(us AS VARCHAR) END AS named,
       CASE WHEN k IN (6, 7) THEN '' WHEN o_custkey % 3 = 0 THEN 'access_time'
            ELSE 'creation_time,access_time' END AS anomalies
FROM (SELECT o_orderkey AS record_number, o_orderkey % 16 AS k, o_custkey, epoch_us(o_orderdate) AS us,
             o_orderstatus <> 'F' AS is_allocated, o_orderpriority = '1-URGENT' AS is_directory FROM orders)
WHERE k NOT IN (0, 1, 2, 3, 9)
""")
def mft_slot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = case.mft_from_slots(standins.mft_slots(spark, sf_dir))
    return records.select(
        "record_number", "embedded_record_number", "is_allocated", "is_directory", "filename",
        _text("parent_record_number"),
        _text("standard_information.creation_time", "created"),
        _text("standard_information.mft_modification_time", "changed"),
        _text("file_name_information.creation_time", "named"),
        F.array_join("timestamp_anomalies", ",").alias("anomalies"),
    )


@query("""
SELECT o_orderkey AS record_number,
       CASE o_orderkey % 16 WHEN 0 THEN 'marked corrupt by the file system' WHEN 1 THEN 'unknown signature'
            WHEN 2 THEN 'sector 2 does not carry the update number'
            ELSE 'the slot ends before its sector numbers do' END AS reason
FROM orders WHERE o_orderkey % 16 IN (0, 1, 2, 9)
""")
def mft_slot_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures = case.mft_from_slots(standins.mft_slots(spark, sf_dir))
    return failures.select("record_number", "reason")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <> l_partkey % 7 + 1
""")
def slot_mismatch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standins.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_linenumber").alias("record_number"),
        (F.col("l_partkey") % 7 + 1).alias("embedded_record_number"),
    )
    return slot_mismatches(rows).select("l_orderkey", "l_linenumber", "l_partkey")


# --- files of a collection ---------------------------------------------------------------------

_CASE_FILES_SQL = """
SELECT 'case-' || (p_partkey % 4) AS case_id,
       'case/' || replace(p_name, ' ', '/') || '-' || p_partkey || e.ending AS path,
       CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS length,
       e.category, p_partkey
FROM part JOIN (VALUES (0, '.EVTX', 'evtx'), (1, '.pf', 'prefetch'), (2, '/$MFT', 'mft'),
  (3, '_mft', 'mft'), (4, '/NTUSER.dat', 'registry'), (5, '/.evtx', NULL), (6, '.txt', NULL),
  (7, '/amcache.hve', NULL)) e(k, ending, category) ON e.k = p_size % 8
"""


@query(f"SELECT path, category FROM ({_CASE_FILES_SQL})")
def artifact_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.case_files(spark, sf_dir).select(
        "path", discovery.classify(F.col("path")).alias("category")
    )


@query(f"""
SELECT coalesce(category, 'unclassified') AS category, count(*) AS files FROM ({_CASE_FILES_SQL}) GROUP BY 1
""")
def discovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = standins.case_files(spark, sf_dir)
    return discovery.counts(files.withColumn("category", discovery.classify(F.col("path"))))


@query(f"""
SELECT count(*) FILTER (category = 'evtx') AS evtx_count, count(*) FILTER (category = 'registry') AS registry_count,
       count(*) FILTER (category = 'prefetch') AS prefetch_count, count(*) FILTER (category = 'mft') AS mft_count,
       count(category) AS total_count, count(*) FILTER (category IS NULL) AS unclassified_count
FROM ({_CASE_FILES_SQL})
""")
def discovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = standins.case_files(spark, sf_dir)
    return discovery.summary(files.withColumn("category", discovery.classify(F.col("path"))))


@query(f"""
SELECT case_id, path AS source_path, CASE WHEN length = 0 THEN 'empty file' ELSE 'not an .evtx file' END AS reason
FROM ({_CASE_FILES_SQL}) WHERE length = 0 OR (p_partkey % 2 = 0 AND NOT ends_with(lower(path), '.evtx'))
""")
def invalid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even parts are handed in as event logs, odd ones as hives, which may have any name."""
    files = standins.case_files(spark, sf_dir)
    number = F.regexp_extract("path", r"-(\d+)", 1).cast("bigint")
    return discovery.invalid_files(files, F.when(number % 2 == 0, "evtx").otherwise("registry"))


# --- what failed, and listings -----------------------------------------------------------------


@query("""
SELECT 'events' AS stage, count(*) AS failures FROM events WHERE event_id % 10 IN (1, 2, 3)
UNION ALL SELECT 'mft', count(*) FROM orders WHERE o_orderkey % 16 IN (0, 1, 2, 9)
UNION ALL SELECT 'prefetch', sum(CASE WHEN c_custkey % 5 < 2 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END)
FROM customer
""")
def failures_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dead letters of all decoders in one table."""
    parts = (
        ("events", case.events_from_xml(standins.event_xml(spark, sf_dir)), "record_number"),
        ("mft", case.mft_from_slots(standins.mft_slots(spark, sf_dir)), "record_number"),
        ("prefetch", case.prefetch_from_rows(_raw_prefetch(spark, sf_dir)), "field_group"),
    )
    letters = [case.failures_of(stage, failures, place) for stage, (_, failures), place in parts]
    return reduce(DataFrame.unionByName, letters).groupBy("stage").agg(F.count(F.lit(1)).alias("failures"))


@query(f"""
SELECT count(*) AS record_count, count(*) FILTER (anomalies <> '') AS timestomped_count,
       count(*) FILTER (is_directory) AS directory_count, count(*) FILTER (NOT is_allocated) AS deleted_count,
       (SELECT count(*) FROM orders WHERE o_orderkey % 16 IN (0, 1, 2, 9)) AS failure_count
FROM ({MFT_SQL})
""")
def mft_summary_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, failures = case.mft_from_slots(standins.mft_slots(spark, sf_dir))
    return reports.mft_summary(standins.mft(spark, sf_dir), failures)


def _keys_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registry keys, their lines as values; some value lists could not be read."""
    value = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("name"))
    lines = standins.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(value)).alias("values")
    )
    orders = standins.read(spark, sf_dir, "orders")
    rows = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    unread = F.col("o_orderkey") % 11 == 0
    return rows.select(
        F.lit("case").alias("case_id"), F.lit("hive").alias("source_path"), "o_orderkey",
        F.concat(F.lit("HKLM\\"), F.col("o_orderpriority")).alias("path"),
        F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("last_written"),
        F.lit(0).alias("subkey_count"), F.size("values").alias("value_count"),
        F.when(~unread, F.col("values")).alias("values"),
        F.when(unread, "values cannot be listed").alias("values_error"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'values cannot be listed' ELSE '' END AS reason,
       CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE l_linenumber END AS number,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE l_returnflag END AS name
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND o_orderkey % 11 > 0
WHERE o_orderkey % 11 = 0 OR l_linenumber IS NOT NULL
""")
def values_under_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key whose value list failed keeps one failure row; the values of the others go on."""
    rows = registry.explode_values(_keys_with_values(spark, sf_dir).drop("name"))
    return rows.select(
        "o_orderkey", F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("value.number", F.lit(-1)).cast("bigint").alias("number"),
        F.coalesce("value.name", F.lit("")).alias("name"),
    )


@query("""
SELECT 'HKLM' || chr(92) || o_orderpriority AS path, o_orderpriority AS name, epoch_us(o_orderdate) AS micros,
       CAST(0 AS BIGINT) AS subkey_count, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS value_count
FROM orders
""")
def key_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys_with_values(spark, sf_dir)
    keys = keys.withColumn("value_count", F.greatest(F.coalesce("value_count", F.lit(0)), F.lit(0)))
    return registry.project_keys(keys).select(
        "path", "name", F.unix_micros("last_written").alias("micros"), "subkey_count", "value_count"
    )


@query("""
SELECT c_name AS executable_name, v.device_path, upper(printf('%08x', c_custkey)) AS serial_number
FROM customer JOIN (SELECT c_custkey AS k, c_mktsegment AS device_path, unnest(range(0, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END)) AS i
                    FROM customer) v ON v.k = c_custkey
""")
def prefetch_volume_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = case.prefetch_from_rows(_raw_prefetch(spark, sf_dir))
    volumes = reports.prefetch_volumes(records)
    name = F.regexp_extract("source_path", r"^(.*)-[0-9A-F]{8}\.pf$", 1)
    return volumes.select(name.alias("executable_name"), "device_path", "serial_number")


@query("""
SELECT executable_name, CAST(i AS INTEGER) AS run_index,
       CAST(1700000000000000 + (c_custkey * 60 + i) * 1000000 AS VARCHAR) AS micros, CAST(2 AS INTEGER) AS filename_count
FROM (SELECT c_name AS executable_name, c_custkey, unnest(CASE WHEN kept = 0 THEN [NULL] ELSE range(kept) END) AS i
      FROM (SELECT *, least(c_custkey % 10, 8, c_custkey % 13) AS kept FROM customer))
""")
def prefetch_run_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight run times, up to the first missing one; a record without any keeps one row."""
    records, _ = case.prefetch_from_rows(_raw_prefetch(spark, sf_dir))
    return reports.prefetch_listing(records).select(
        "executable_name", "run_index", F.unix_micros("run_time").cast("string").alias("micros"), "filename_count"
    )


@query("""
SELECT p_brand, first, CAST(n AS BIGINT) AS labels FROM (
  SELECT p_brand, count(*) AS n, arg_min(label, (CASE WHEN p_size % 3 = 0 THEN p_size * 1.0 ELSE 1e9 END, label)) AS first
  FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'x' || p_size END AS label FROM part)
  GROUP BY p_brand)
""")
def numeric_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label of each container when numbers sort by value and before other texts."""
    size = F.col("p_size")
    label = F.when(size % 3 == 0, size.cast("string")).otherwise(F.concat(F.lit("x"), size.cast("string")))
    rows = standins.read(spark, sf_dir, "part").withColumn("label", label)
    return rows.groupBy("p_brand").agg(
        F.min_by("label", F.struct(*numeric_first("label"))).alias("first"),
        F.count(F.lit(1)).alias("labels"),
    )
