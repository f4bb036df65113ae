"""The four tables of a case and their readers.

Readers take decoded landing rows in any table format Spark reads, tag each row with the file it
came from where the rows do not say, and return all columns of the table's schema. Missing inputs
are empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from gainsay import schemas
from gainsay.functions import events as event_xml
from gainsay.functions import prefetch, registry
from gainsay.functions.time import utc
from gainsay.operators import slots as slot_decoder
from gainsay.operators.rows import split_failures, without_bad_files
from gainsay.sources import discovery
from gainsay.sources.pieces import decode_pieces
from gainsay.sources.slots import RECORD_BYTES, read_slots


@dataclass(frozen=True)
class CaseTables:
    """Tables of one or many cases; ``case_id`` keeps cases apart in every rule."""

    events: DataFrame
    registry_values: DataFrame
    prefetch: DataFrame
    mft: DataFrame

    @classmethod
    def build(
        cls,
        spark: SparkSession,
        events: DataFrame | None = None,
        registry_values: DataFrame | None = None,
        prefetch: DataFrame | None = None,
        mft: DataFrame | None = None,
    ) -> CaseTables:
        """Tables from whichever inputs there are; None means an empty table."""

        def table(df: DataFrame | None, schema: StructType) -> DataFrame:
            return spark.createDataFrame([], schema) if df is None else conform(df, schema)

        return cls(
            table(events, schemas.EVENTS),
            table(registry_values, schemas.REGISTRY_VALUES),
            table(prefetch, schemas.PREFETCH),
            table(mft, schemas.MFT),
        )

    def named(self) -> dict[str, DataFrame]:
        return {
            "events": self.events,
            "registry_values": self.registry_values,
            "prefetch": self.prefetch,
            "mft": self.mft,
        }

    def create_views(self) -> None:
        for name, df in self.named().items():
            df.createOrReplaceTempView(name)

    def without(self, bad_files: DataFrame) -> CaseTables:
        """Leave out every row of a bad file, also rows read before the failure."""
        return replace(
            self, **{n: without_bad_files(df, bad_files) for n, df in self.named().items()}
        )

    def row_counts(self) -> DataFrame:
        """Rows per table."""
        parts = [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in self.named().items()
        ]
        first, *rest = parts
        for part in rest:
            first = first.unionByName(part)
        return first


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """All columns of ``schema`` in order; absent ones are NULL, zone-less times become UTC.

    A value that does not fit its column becomes NULL and takes nothing else with it.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (fitted(F.col(f.name), have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in schema.fields
        ]
    )


def fitted(value: Column, have: DataType, want: DataType) -> Column:
    """``value`` as ``want``, part by part, so that a bad part is the only one lost."""
    if have == want:
        return value
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return F.transform(value, lambda x: fitted(x, have.elementType, want.elementType))
    if isinstance(have, StructType) and isinstance(want, StructType):
        there = {f.name: f.dataType for f in have.fields}
        parts = [
            (fitted(value[f.name], there[f.name], f.dataType) if f.name in there else F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(have, TimestampNTZType) and isinstance(want, TimestampType):
        return utc(value)
    return value.try_cast(want)


def plain_path(uri: Column) -> Column:
    """One spelling of a file's name for all readers: no scheme for local files, nothing percent-encoded."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/+", "/")


def read_rows(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType | None = None,
    format: str = "parquet",
    pattern: str | None = None,
    case_id: str | Column = "case",
    more: dict[str, str] | None = None,
    **options: str,
) -> DataFrame:
    """Landing rows of files and folders. A path given twice is read twice.

    ``pattern`` keeps only files of that name pattern directly in a folder. Rows without
    ``source_path`` or ``case_id`` get the file's path and the given case.
    """
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(paths if isinstance(paths, str) else list(paths))
    own = {name: F.col(column) for name, column in (more or {}).items()}
    own["source_path"] = plain_path(F.col("_metadata.file_path"))
    own["case_id"] = case_id if isinstance(case_id, Column) else F.lit(case_id)
    missing = {name: column for name, column in own.items() if name not in df.columns}
    filled = {name: F.coalesce(F.col(name), own[name]) for name in own if name in df.columns}
    return df.withColumns({**missing, **filled})


def decode_with(
    spark: SparkSession,
    paths: str | Sequence[str],
    decoder: Callable[[Iterable], Iterable],
    schema: StructType | str,
    case_id: str | Column = "case",
) -> DataFrame:
    """Run a caller's decoder over whole files, for formats that only a third-party library reads.

    ``decoder`` takes and gives Arrow batches (path, content, case_id in; rows of ``schema`` out).
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    case = case_id if isinstance(case_id, Column) else F.lit(case_id)
    return files.select(
        plain_path(F.col("_metadata.file_path")).alias("source_path"), "content", case.alias("case_id")
    ).mapInArrow(decoder, schema)


def read_xml_export(
    spark: SparkSession, paths: str | Sequence[str], case_id: str | Column = "case"
) -> DataFrame:
    """Event XML rows from exported text files, split at the end tag so large files stay divisible.

    An event that the end of its file cuts off keeps its missing end tag and so becomes a failure.
    """
    end = "</Event>"
    rows = read_rows(
        spark, paths, format="text", case_id=case_id, lineSep=end,
        more={"_size": "_metadata.file_size", "_block": "_metadata.file_block_start"},
    ).withColumn("_place", F.monotonically_increasing_id())
    is_event = F.expr("regexp_instr(value, '<Event[ >/]')")
    # The pieces of a file and the tags between them fill the file just when the last piece has no tag.
    files = rows.groupBy("source_path").agg(
        F.max(F.struct("_block", "_place", (is_event > 0).alias("event"))).alias("last"),
        (F.sum(F.octet_length("value") + len(end)) > F.max("_size")).alias("open"),
    )
    cut_off = files.filter(F.col("open") & F.col("last.event")).select(
        "source_path", "last._block", "last._place", F.lit(True).alias("_cut")
    )
    tag = F.when(F.col("_cut"), "").otherwise(end)
    return (
        rows.withColumn("_start", is_event)
        .filter(F.col("_start") > 0)
        .join(cut_off, ["source_path", "_block", "_place"], "left")
        .select(
            "case_id", "source_path", F.concat(F.expr("substring(value, _start)"), tag).alias("raw_xml")
        )
    )


def events_from_xml(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event records and dead-letter rows. The event's own number stands in where none is given."""
    if "record_number" not in rows.columns:
        rows = rows.withColumn("record_number", F.lit(None).cast("bigint"))

    def numbered(decoded: DataFrame) -> DataFrame:
        return decoded.withColumn(
            "record_number", F.coalesce("record_number", "embedded_record_number")
        ).withColumn(
            "reason",
            F.coalesce("reason", F.when(F.col("record_number").isNull(), "no record number")),
        )

    # Each is parsed when it is read: what failed needs no fields.
    good, _ = split_failures(numbered(event_xml.decode(rows)))
    _, bad = split_failures(numbered(event_xml.unusable(rows)))
    return conform(good, schemas.EVENTS), bad


def values_from_rows(rows: DataFrame, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Registry values and dead-letter rows, optionally only at and below the key ``root``."""
    if root is not None:
        rows = rows.filter(registry.under_key(F.col("key_path"), root))
    good, bad = split_failures(
        registry.project_values(rows), ("case_id", "source_path", "key_path")
    )
    return conform(good, schemas.REGISTRY_VALUES), bad


def files_without_root(rows: DataFrame, root: str, path: str = "key_path") -> DataFrame:
    """Bad-file rows for hives in which the requested start key does not exist."""
    return (
        rows.groupBy("case_id", "source_path")
        .agg(F.bool_or(registry.under_key(F.col(path), root)).alias("found"))
        .filter(~F.col("found"))
        .select("case_id", "source_path", F.lit("root key not found").alias("reason"))
    )


def prefetch_from_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefetch records and one dead-letter row per unreadable field."""
    decoded = prefetch.decode(rows)
    return conform(decoded, schemas.PREFETCH), prefetch.field_failures(decoded)


def mft_from_slots(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File records and dead-letter rows."""
    good, bad = split_failures(slot_decoder.decode(slots))
    return conform(good, schemas.MFT), bad


def read_mft(
    spark: SparkSession,
    paths: Sequence[str],
    case_id: str | Column = "case",
    record_bytes: int = RECORD_BYTES,
) -> tuple[DataFrame, DataFrame]:
    return mft_from_slots(read_slots(spark, list(paths), case_id, record_bytes))


class Ingested(NamedTuple):
    """Tables of a case, one dead-letter row per record or field that failed, and files left out as a whole."""

    tables: CaseTables
    failures: DataFrame
    bad_files: DataFrame


def failures_of(stage: str, failures: DataFrame, place: str) -> DataFrame:
    """Dead-letter rows of a stage in the common form; ``place`` says where in the file."""
    return failures.select(
        "case_id", "source_path", F.lit(stage).alias("stage"), F.col(place).cast("string").alias("place"), "reason"
    )


def _landing(
    spark: SparkSession, paths: Sequence[str], schema: StructType, format: str, case_id: str | Column
) -> DataFrame:
    """Landing rows with every column of ``schema``. What a file has keeps its own type."""
    own_types = format in ("parquet", "orc", "avro")
    rows = read_rows(spark, list(paths), None if own_types else _as_text(schema), format, case_id=case_id)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def _as_text(schema: StructType) -> StructType:
    """The schema with its plain numbers as text, so that a bad one can be told from a missing one."""
    return StructType([
        StructField(f.name, StringType() if isinstance(f.dataType, (LongType, IntegerType)) else f.dataType)
        for f in schema.fields
    ])


def ingest(
    spark: SparkSession,
    event_paths: Sequence[str] = (),
    registry_paths: Sequence[str] = (),
    prefetch_paths: Sequence[str] = (),
    mft_paths: Sequence[str] = (),
    *,
    format: str = "parquet",
    case_id: str | Column = "case",
    bad_files: DataFrame | None = None,
    record_bytes: int = RECORD_BYTES,
    root_key: str | None = None,
) -> Ingested:
    """Tables of a case from landing files, with what failed; every input may be left out.

    Event rows are event XML, registry and prefetch rows are decoder output, and file-record tables
    are raw. ``bad_files`` names sources to leave out as a whole; hives without ``root_key`` are added
    to them, of the others only what is at and below it is taken.
    """
    bad = [] if bad_files is None else [conform(bad_files, schemas.BAD_FILES)]
    made: dict[str, DataFrame | None] = dict.fromkeys(("events", "registry_values", "prefetch", "mft"))
    failed = []
    if event_paths:
        rows = conform(_landing(spark, event_paths, schemas.EVENT_XML, format, case_id), schemas.EVENT_XML)
        made["events"], failures = events_from_xml(rows)
        failed.append(failures_of("events", failures, "record_number"))
    if registry_paths:
        rows = _landing(spark, registry_paths, schemas.REGISTRY_VALUES, format, case_id)
        made["registry_values"], failures = values_from_rows(rows, root_key)
        failed.append(failures_of("registry_values", failures, "key_path"))
        if root_key is not None:
            bad.append(conform(files_without_root(rows, root_key), schemas.BAD_FILES))
    if prefetch_paths:
        rows = _landing(spark, prefetch_paths, schemas.PREFETCH_RAW, format, case_id)
        made["prefetch"], failures = prefetch_from_rows(rows)
        failed.append(failures_of("prefetch", failures, "field_group"))
    if mft_paths:
        made["mft"], failures = read_mft(spark, mft_paths, case_id, record_bytes)
        failed.append(failures_of("mft", failures, "record_number"))
    tables = CaseTables.build(spark, **made)
    left_out = reduce(DataFrame.unionByName, bad) if bad else spark.createDataFrame([], schemas.BAD_FILES)
    letters = reduce(DataFrame.unionByName, failed) if failed else spark.createDataFrame([], schemas.FAILURES)
    return Ingested(tables.without(left_out) if bad else tables, letters, left_out)


def build_context(spark: SparkSession, *paths: Sequence[str], **options) -> CaseTables:
    """Only the tables of ``ingest``."""
    return ingest(spark, *paths, **options).tables


def open_folder(
    spark: SparkSession,
    folder: str,
    *,
    case_id: str | Column = "case",
    decoders: dict[str, tuple] | None = None,
    record_bytes: int = RECORD_BYTES,
    root_key: str | None = None,
) -> Ingested:
    """From a folder of artifacts to the tables of its case: discover, check, load, leave out bad files.

    File-record tables are read as they are. The other kinds are binary formats: ``decoders`` maps
    "evtx", "registry" and "prefetch" to a decoder of whole files and the schema of its rows (see
    ``decode_with``), or to a decoder of pieces, its schema and a splitter (see ``pieces.decode_pieces``): then files
    of any size are read by many tasks and their paths stay rows. Files of a kind without a decoder are bad files.
    ``case_id`` may be an expression over ``source_path``.
    """
    decoders = decoders or {}
    case = case_id if isinstance(case_id, Column) else F.lit(case_id)
    files = discovery.discover(spark, folder).withColumn("source_path", F.col("path")).withColumn("case_id", case)
    known = files.filter(F.col("category").isNotNull())
    undecoded = ~F.col("category").isin("mft", *decoders)
    bad = discovery.invalid_files(known, F.col("category")).unionByName(
        known.filter(undecoded & (F.col("length") > 0)).select(
            "case_id", F.col("path").alias("source_path"), F.lit("no decoder for this kind").alias("reason")
        )
    )
    usable = known.join(bad.select("source_path").distinct(), "source_path", "left_anti")
    in_pieces = [c for c, given in decoders.items() if len(given) == 3]
    found = usable.filter(~F.col("category").isin(in_pieces)).select("category", "path").collect()
    paths = {c: sorted(r["path"] for r in found if r["category"] == c) for c in discovery.CATEGORIES}
    present = {c for c in discovery.CATEGORIES if c in in_pieces or paths[c]}
    made: dict[str, DataFrame | None] = dict.fromkeys(("events", "registry_values", "prefetch", "mft"))
    failed = []

    def decoded(category: str) -> DataFrame:
        if category in in_pieces:
            decoder, schema, splitter = decoders[category]
            return decode_pieces(usable.filter(F.col("category") == category), splitter, decoder, schema)
        decoder, schema = decoders[category]
        return decode_with(spark, paths[category], decoder, schema, case_id)

    if "evtx" in present:
        made["events"], failures = events_from_xml(conform(decoded("evtx"), schemas.EVENT_XML))
        failed.append(failures_of("events", failures, "record_number"))
    if "registry" in present:
        rows = decoded("registry")
        made["registry_values"], failures = values_from_rows(rows, root_key)
        failed.append(failures_of("registry_values", failures, "key_path"))
        if root_key is not None:
            bad = bad.unionByName(files_without_root(rows, root_key))
    if "prefetch" in present:
        made["prefetch"], failures = prefetch_from_rows(decoded("prefetch"))
        failed.append(failures_of("prefetch", failures, "field_group"))
    if "mft" in present:
        made["mft"], failures = read_mft(spark, paths["mft"], case_id, record_bytes)
        failed.append(failures_of("mft", failures, "record_number"))
    letters = reduce(DataFrame.unionByName, failed) if failed else spark.createDataFrame([], schemas.FAILURES)
    return Ingested(CaseTables.build(spark, **made).without(bad), letters, bad)
