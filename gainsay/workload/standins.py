"""Benchmark tables in the shape of artifact tables, made by Spark expressions over whole tables.

Cases are numbered by key modulo four. The SQL in ``oracle`` restates the same mappings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gainsay.functions.events import EVENT_NAMESPACE
from gainsay.functions.text import html_escape, iso_timestamp
from gainsay.functions.time import timestamp_to_filetime, utc
from gainsay.functions.prefetch import filename_hash_matches, hash_hex
from gainsay.functions.mft import timestamp_anomalies
from gainsay.sources.case import CaseTables

SLOT_BYTES = 1024
_USA_OFFSET, _FIRST_ATTRIBUTE = 48, 56
_UPDATE_NUMBER = b"\x07\x00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def case_of(key: str) -> Column:
    return F.concat(F.lit("case-"), (F.col(key) % 4).cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records: one log per user, clicks and views are process creations."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        case_of("user_id").alias("case_id"),
        F.concat(F.lit("logs/user-"), F.col("user_id").cast("string"), F.lit(".evtx")).alias("source_path"),
        F.col("event_id").alias("record_number"),
        F.when(kind == "click", 4688).when(kind == "view", 1).otherwise(7).cast("bigint").alias("event_id"),
        utc(F.col("ts")).alias("timestamp"),
        kind.alias("provider_name"),
        F.concat(F.lit("HOST-"), (F.col("user_id") % 10).cast("string")).alias("computer_name"),
        F.lit("Security").alias("channel"),
        (F.col("event_id") % 5).alias("level"),
        F.col("props").alias("message"),
        F.col("props").alias("raw_xml"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefetch records of purchases: the name is a text that other events may hold."""
    return read(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        case_of("user_id").alias("case_id"),
        F.concat(F.lit("pf/run-"), F.col("event_id").cast("string"), F.lit(".pf")).alias("source_path"),
        F.concat(F.lit('"K": '), (F.col("user_id") % 100).cast("string"), F.lit("}")).alias("executable_name"),
        F.array(utc(F.col("ts"))).alias("last_run_times"),
        F.lit(1).cast("bigint").alias("run_count"),
    )


def prefetch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefetch records of customers: a file name and an embedded hash."""
    suffix = F.when(F.col("c_custkey") % 7 == 0, ".PF").otherwise(".pf")
    key = F.col("c_custkey")
    in_name = F.when(key % 3 == 0, hash_hex(key)).when(key % 3 == 1, F.lower(hash_hex(key + 1)))
    name = F.coalesce(
        F.concat(F.col("c_name"), F.lit("-"), in_name, suffix), F.concat(F.col("c_name"), suffix)
    )
    path = F.concat(F.lit("pf\\"), name)
    return read(spark, sf_dir, "customer").select(
        case_of("c_custkey").alias("case_id"),
        path.alias("source_path"),
        F.col("c_name").alias("executable_name"),
        hash_hex(key).alias("prefetch_hash"),
        filename_hash_matches(path, hash_hex(key)).alias("filename_hash_matches"),
    )


def executed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefetch records of parts; cheap ones count as run."""
    return read(spark, sf_dir, "part").select(
        case_of("p_partkey").alias("case_id"),
        F.concat(F.lit("pf/part-"), F.col("p_partkey").cast("string"), F.lit(".pf")).alias("source_path"),
        F.concat(F.col("p_brand"), F.lit(".exe")).alias("executable_name"),
        F.when((F.col("p_size") <= 1) & (F.col("p_retailprice") < 1200), 1)
        .when(F.col("p_size") < 25, 0)
        .cast("bigint")
        .alias("run_count"),
    )


def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry values of parts: startup entries for even sizes, list data for sizes ending in 7."""
    even = F.col("p_size") % 2 == 0
    is_list = F.col("p_size") % 10 == 7
    command = F.concat(F.lit('"C:\\bin\\'), F.col("p_brand"), F.lit('.EXE" -k'))
    data = F.struct(
        F.when(is_list, "list").otherwise("text").alias("kind"),
        F.when(~is_list, command).alias("s"),
        F.lit(None).cast("bigint").alias("i"),
        F.lit(None).cast("binary").alias("b"),
        F.when(is_list, F.array(command)).alias("l"),
    )
    return read(spark, sf_dir, "part").select(
        case_of("p_partkey").alias("case_id"),
        F.concat(F.lit("hives/"), (F.col("p_partkey") % 10).cast("string"), F.lit("/NTUSER.DAT")).alias("source_path"),
        F.concat(
            F.lit("HKLM\\"), F.col("p_type"), F.when(even, "\\Run").otherwise("\\RunAs")
        ).alias("key_path"),
        F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("name"),
        F.lit(1).cast("bigint").alias("value_type"),
        F.lit("RegSZ").alias("value_type_str"),
        data.alias("data"),
        F.encode(F.col("p_brand"), "UTF-8").alias("raw_data_bytes"),
        F.col("p_partkey"),
        F.col("p_size"),
    )


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their order: name made at the order date, standard times at shipping."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        utc(F.col("l_shipdate")).alias("shipped"),
    )
    orders = read(spark, sf_dir, "orders").select("o_orderkey", utc(F.col("o_orderdate")).alias("ordered"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")


def mft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shipments(spark, sf_dir)
    times = {
        "creation_time": F.col("shipped"),
        "modification_time": F.col("shipped") + F.expr("INTERVAL '30' DAY"),
    }
    anomalies = timestamp_anomalies(times, F.col("ordered"))
    return rows.select(
        case_of("l_orderkey").alias("case_id"),
        F.concat(F.lit("vol"), (F.col("l_suppkey") % 8).cast("string"), F.lit("/$MFT")).alias("source_path"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_number"),
        F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("filename"),
        (F.col("l_linestatus") == "F").alias("is_directory"),
        (F.col("l_returnflag") != "R").alias("is_allocated"),
        anomalies.alias("timestamp_anomalies"),
        (F.size(anomalies) > 0).alias("likely_timestomped"),
    )


def case_tables(spark: SparkSession, sf_dir: str) -> CaseTables:
    """All five rules have something to find in these."""
    prefetch = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [f(spark, sf_dir) for f in (purchases, prefetch_files, executed_parts)],
    )
    return CaseTables.build(
        spark,
        events=events(spark, sf_dir),
        registry_values=registry_values(spark, sf_dir),
        prefetch=prefetch,
        mft=mft(spark, sf_dir),
    )


def event_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as XML text; the last digit of the number picks a well-formed or a damaged shape.

    Of the plain ones (0, 4 and 5) the number makes some with repeated fields, mixed content, a prefix
    or another root, which are the same events to a tree parser, some with a field or the data in another
    namespace or only System in the right one, which have none of it, and some with a blank computer.
    """
    digit = F.col("event_id") % 10
    head = F.lit(f'<?xml version="1.0" encoding="utf-8"?>\n<Event xmlns="{EVENT_NAMESPACE}">')
    number = F.when(digit == 4, "n/a").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\n")))
    instant = F.when(digit == 5, "not a time").otherwise(
        F.replace(iso_timestamp(utc(F.col("ts"))), F.lit("+00:00"), F.lit("Z"))
    )
    system = F.concat(
        F.lit("<System>"),
        F.when(digit == 6, "<Provider/>").otherwise(
            F.concat(F.lit('<Provider Name="'), F.col("event_type"), F.lit('" Guid="{1}"/>'))
        ),
        F.lit('<EventID Qualifiers="16384">'), number, F.lit("</EventID><Level>4</Level>"),
        F.lit('<TimeCreated SystemTime="'), instant, F.lit('"/><EventRecordID>'),
        F.col("event_id").cast("string"), F.lit("</EventRecordID><Channel></Channel><Computer> HOST-"),
        F.col("user_id").cast("string"), F.lit(" </Computer></System>"),
    )
    before = (
        F.when(digit == 7, "<EventData/><UserData><a>")
        .when(digit == 8, '<UserData><x xmlns="urn:x"><a>')
        .when(digit == 9, "")
        .otherwise('<EventData><Data Name="p"> ')
    )
    after = (
        F.when(digit == 7, "</a></UserData>")
        .when(digit == 8, "</a></x></UserData>")
        .when(digit == 9, "")
        .otherwise(F.concat(
            F.lit("</Data>\n<Data> </Data><Data><b>"), F.col("event_type"),
            F.lit("</b>tail</Data></EventData>"),
        ))
    )
    end = F.when(digit == 1, "</Sys").when(digit == 3, "</Event><Event/>").otherwise("</Event>")
    shape = F.when(digit.isin(0, 4, 5), F.floor(F.col("event_id") / 10) % 9).otherwise(-1)

    def shaped(text: Column) -> Column:
        named = F.replace(F.replace(text, F.lit("<Event "), F.lit("<Entry ")), F.lit("</Event>"), F.lit("</Entry>"))
        own = F.lit(f' xmlns="{EVENT_NAMESPACE}"')
        spaced = F.regexp_replace(text, r"<(/?)([A-Z][A-Za-z]*|b)(?=[ />])", "<$1e:$2")
        return (
            F.when(shape == 1, F.replace(text, F.lit("</EventID>"), F.lit("</EventID><EventID>7</EventID>")))
            .when(shape == 2, F.replace(text, F.lit("<Level>4<"), F.lit("<Level>x<y/>4<")))
            .when(shape == 3, F.replace(spaced, F.lit(" xmlns="), F.lit(" xmlns:e=")))
            .when(shape == 4, named)
            .when(shape == 5, F.replace(text, F.lit("<Level>4"), F.lit('<Level xmlns="urn:x">4')))
            .when(shape == 6, F.replace(text, F.lit("<EventData>"), F.lit('<EventData xmlns="urn:x">')))
            .when(shape == 7, F.replace(F.replace(text, own, F.lit("")), F.lit("<System>"), F.concat(F.lit("<System"), own, F.lit(">"))))
            .when(shape == 8, F.regexp_replace(text, "<Computer>[^<]*<", "<Computer> \n<"))
            .otherwise(text)
        )

    # The table may be one file of one piece; making and reading XML is worth dealing it out.
    pieces = spark.sparkContext.defaultParallelism
    text = F.concat(
        head,
        F.when(digit == 2, "").otherwise(system),
        before,
        F.when(digit == 9, "").otherwise(html_escape(F.col("props"))),
        after,
        end,
    )
    # A column of its own: written out in every shape, the expression is too long for compiled code.
    events = read(spark, sf_dir, "events").repartition(pieces, "event_id").withColumn("_text", text)
    return events.select(
        case_of("user_id").alias("case_id"),
        F.concat(F.lit("xml/user-"), F.col("user_id").cast("string")).alias("source_path"),
        F.col("event_id").alias("record_number"),
        shaped(F.col("_text")).alias("raw_xml"),
    )


def little_endian(value: Column | int, count: int) -> Column:
    """The low bytes of a number, lowest first, as hex digits."""
    if isinstance(value, int):
        return F.lit(value.to_bytes(count, "little").hex())
    highest_first = F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * count, "0"))
    # One character per byte, so reversing the text reverses the bytes.
    text = F.reverse(F.decode(highest_first, "ISO-8859-1"))
    return F.hex(F.encode(text, "ISO-8859-1"))


def _hex(raw: bytes) -> Column:
    return F.lit(raw.hex())


def _fill(digits: Column, count: Column) -> Column:
    """Zeros up to ``count`` digits; far cheaper than a pad, which copies one character at a time."""
    return F.concat(digits, F.lit("0" * SLOT_BYTES)).substr(F.lit(1), count)


def _attribute(kind: int, content: Column, size: Column | int) -> Column:
    """A resident attribute: 24 header bytes, then the content, padded to eight bytes."""
    padded = -(-size // 8) * 8 if isinstance(size, int) else size + F.pmod(-size, F.lit(8))
    return F.concat(
        little_endian(kind, 4), little_endian(24 + padded, 4), _hex(bytes(8)),
        little_endian(size, 4), little_endian(24, 2), _hex(bytes(2)),
        _fill(content, F.lit(2) * padded),
    )


def _file_name(parent: Column | int, created: Column, name: Column, namespace: Column | int) -> Column:
    chars = F.length(name)
    content = F.concat(
        little_endian(parent, 8), F.repeat(little_endian(created, 8), 4), _hex(bytes(24)),
        little_endian(chars, 1), little_endian(namespace, 1), F.hex(F.encode(name, "UTF-16LE")),
    )
    return _attribute(0x30, content, 66 + 2 * chars)


def mft_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw slot per order, put together as hex digits; the key modulo 16 picks an intact or a
    damaged shape."""
    kind, named = F.col("_kind"), F.col("_named")
    day = 864_000_000_000
    back = (F.col("o_custkey") % 3) * day
    standard = _attribute(0x10, F.concat(
        little_endian(named - back, 8), little_endian(named + day, 8),
        little_endian(F.when(kind == 5, 0).otherwise(named - 10_000_000), 8),
        little_endian(named - 10_000_010, 8), _hex(bytes(16)),
    ), 48)
    parent = F.col("o_custkey") + F.lit(3 << 48)
    short = _file_name(5, named + day, F.lit("ORDRE~1"), 2)
    flags = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1) + F.when(
        F.col("o_orderpriority") == "1-URGENT", 2
    ).otherwise(0)
    signature = F.when(kind == 0, _hex(b"BAAD")).when(kind == 1, _hex(b"????"))
    slot = F.concat(
        signature.otherwise(_hex(b"FILE")), little_endian(_USA_OFFSET, 2),
        F.when(kind == 9, little_endian(0, 2)).otherwise(little_endian(3, 2)),
        _hex(bytes(12)), little_endian(_FIRST_ATTRIBUTE, 2), little_endian(flags, 2),
        little_endian(SLOT_BYTES, 4), _hex(bytes(16)), little_endian(F.col("o_orderkey"), 4),
        _hex(_UPDATE_NUMBER + bytes(6)),
        F.when(kind == 6, "").otherwise(standard),
        F.when(kind == 4, short).otherwise(""),
        F.when(kind == 7, "").otherwise(_file_name(parent, named, F.col("_name"), kind % 4)),
        little_endian(0xFFFFFFFF, 4),
    )
    tail = F.when(kind == 2, _hex(b"\xff\xff")).otherwise(_hex(_UPDATE_NUMBER))
    # A slot has two sectors; the last two bytes of each carry the update number.
    raw = F.concat(
        _fill(slot, F.lit(SLOT_BYTES - 4)), _hex(_UPDATE_NUMBER),
        F.lit("00" * (SLOT_BYTES // 2 - 2)), tail,
    )
    return (
        read(spark, sf_dir, "orders")
        .repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
        .withColumn("_kind", F.col("o_orderkey") % 16)
        .withColumn("_named", timestamp_to_filetime(utc(F.col("o_orderdate"))))
        .withColumn("_name", F.concat(F.lit("ordre-é-"), F.col("o_orderkey").cast("string")))
        .select(
            case_of("o_orderkey").alias("case_id"),
            F.concat(F.lit("disk"), (F.col("o_custkey") % 8).cast("string"), F.lit("/$MFT")).alias("source_path"),
            F.col("o_orderkey").alias("record_number"),
            F.when(kind == 3, F.lit(bytes(SLOT_BYTES))).otherwise(F.unhex(raw)).alias("raw"),
        )
    )


def key_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as parent-linked registry keys; some nations are unreadable."""
    regions = read(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("bigint").alias("key_id"),
        F.lit(None).cast("bigint").alias("parent_id"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("reason"),
    )
    nations = read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 100).cast("bigint").alias("key_id"),
        F.col("n_regionkey").cast("bigint").alias("parent_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 11 == 3, "unreadable").alias("reason"),
    )
    customers = read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1000).alias("key_id"),
        (F.col("c_nationkey") + 100).cast("bigint").alias("parent_id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("reason"),
    )
    return (
        regions.unionByName(nations)
        .unionByName(customers)
        .select(F.lit("case").alias("case_id"), F.lit("hive").alias("source_path"), "*")
    )


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of a collection; the size picks the kind of name."""
    # One file name ending per size modulo 8.
    endings = (".EVTX", ".pf", "/$MFT", "_mft", "/NTUSER.dat", "/.evtx", ".txt", "/amcache.hve")
    ending = F.element_at(
        F.array(*[F.lit(e) for e in endings]), (F.col("p_size") % 8 + 1).cast("int")
    )
    return read(spark, sf_dir, "part").select(
        case_of("p_partkey").alias("case_id"),
        F.concat(
            F.lit("case/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("-"),
            F.col("p_partkey").cast("string"), ending,
        ).alias("path"),
        F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(F.col("p_size")).cast("bigint").alias("length"),
    )
