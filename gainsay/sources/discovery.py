"""Which files of a collection are which artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gainsay.functions.text import basename
from gainsay.sources.files import list_files

CATEGORIES = ("evtx", "registry", "prefetch", "mft")

# Names by which artifacts are recognised, in lower case.
MFT_NAMES = ("$mft", "mft")
MFT_SUFFIX = "_mft"
HIVE_NAMES = ("system", "software", "sam", "security", "default", "ntuser.dat", "usrclass.dat")


def classify(path: Column) -> Column:
    """Artifact category of a path by its file name, or NULL. The first match wins."""
    name = F.lower(basename(path))
    # A leading dot starts a hidden name, not an extension.
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return (
        F.when(suffix == ".evtx", "evtx")
        .when(suffix == ".pf", "prefetch")
        .when(name.isin(*MFT_NAMES) | F.endswith(name, F.lit(MFT_SUFFIX)), "mft")
        .when(name.isin(*HIVE_NAMES), "registry")
    )


def discover(spark: SparkSession, folder: str, case_id: str | Column | None = None) -> DataFrame:
    """Every regular file below ``folder`` with its category; no file is opened.

    ``case_id`` may be a fixed text or an expression over ``path``; by default one case is assumed.
    """
    case = case_id if isinstance(case_id, Column) else F.lit(case_id or "case")
    return list_files(spark, folder).withColumns(
        {"case_id": case, "category": classify(F.col("path"))}
    )


def paths_of(files: DataFrame, category: str) -> DataFrame:
    """Paths of one category in order."""
    return files.filter(F.col("category") == category).select("case_id", "path").orderBy("path")


def counts(files: DataFrame) -> DataFrame:
    """Files per category, the unclassified ones included."""
    return files.groupBy(F.coalesce("category", F.lit("unclassified")).alias("category")).agg(
        F.count(F.lit(1)).alias("files")
    )


def summary(files: DataFrame) -> DataFrame:
    """One row: files per category, recognised files, unclassified files."""
    return files.agg(
        *[F.count_if(F.col("category") == c).alias(f"{c}_count") for c in CATEGORIES],
        F.count("category").alias("total_count"),
        F.count_if(F.col("category").isNull()).alias("unclassified_count"),
    )


def invalid_files(files: DataFrame, expected: Column) -> DataFrame:
    """Bad-file rows for listed files that cannot be a source of the ``expected`` kind.

    Event logs and prefetch files must carry their extension; hives and file-record tables are
    taken under any name. Empty files hold nothing to read.
    """
    name = F.lower(basename(F.col("path")))
    reason = (
        F.when(F.col("length") == 0, "empty file")
        .when((expected == "evtx") & ~F.endswith(name, F.lit(".evtx")), "not an .evtx file")
        .when((expected == "prefetch") & ~F.endswith(name, F.lit(".pf")), "not a .pf file")
    )
    return (
        files.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("case_id", F.col("path").alias("source_path"), "reason")
    )


def missing_files(requested: DataFrame, files: DataFrame) -> DataFrame:
    """Bad-file rows for requested paths that the discovery did not see."""
    found = files.select("case_id", F.col("path").alias("source_path"))
    return requested.join(found, ["case_id", "source_path"], "left_anti").select(
        "case_id", "source_path", F.lit("file not found").alias("reason")
    )
