"""Clean a corpus in stages; each works on all that the stage before it kept.

toxicity -> MinHash near-dedup -> benchmark decontamination -> personal data -> packing

All stages but the last return the columns of their input. Null and empty texts pass the filters: they are
not toxic, hold no benchmark item and no personal data; of rows with equal texts, empty ones too, one
stays. Rows without a doc_id are judged like others; equal ids with different texts are different
documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count, islice

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.llm import containment, packing, pii, probminhash, toxicity
from gainsay.llm.common import read, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer does not call toxic."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    key, kept_id, kept_key = _free_names(docs, 3)
    kept = probminhash.near_copies(docs).filter("kept").select(
        F.col("doc_id").alias(kept_id), F.col("md5").alias(kept_key)
    )
    same = (F.col(key) == F.col(kept_key)) & F.col("doc_id").eqNullSafe(F.col(kept_id))
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = keyed.join(kept, same, "left_semi")
    # Rows that repeat the kept document, id and text alike.
    return rows.dropDuplicates(["doc_id", key]).select(*docs.columns)


def _free_names(docs: DataFrame, number: int) -> list[str]:
    """Names that no column has."""
    taken = {name.lower() for name in docs.columns}
    return list(islice((name for name in map("_key_{}".format, count()) if name not in taken), number))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return containment.without_items(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind, and its length as it is then."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids: one row per piece of a document."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

# Models, signatures and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
