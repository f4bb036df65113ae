import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """A frame like the documents table from (doc_id, text) pairs."""

    def make(rows, source="s"):
        return spark.createDataFrame(
            [(i, t, "en", source, None if t is None else len(t)) for i, t in rows], DOCS
        )

    return make
