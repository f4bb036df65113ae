"""Slices, samples and columns whose names clash with those of the operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gainsay.llm import packing, pii, probminhash, quality, secrets
from gainsay.llm.common import SLICE_ROWS, slices, staged, thinned


def test_slices_hold_every_row_once_within_bounds():
    texts = ["x" * n for n in (5, 0, 7, 300, 1, 1, 1)] + [None] + [""] * (SLICE_ROWS + 5)
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(len(texts)))})
    parts = list(slices(batch, "text", 10))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(len(texts)))
    for p in parts:
        sizes = [len(t or "") for t in p.column("text").to_pylist()]
        assert p.num_rows <= SLICE_ROWS and (sum(sizes) <= 10 or p.num_rows == 1)
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_thinned_takes_the_same_share_every_time(spark):
    df = spark.range(10_000)
    some = thinned(df, ["id"], 1_000, 10_000)
    assert 800 < some.count() < 1200 and some.exceptAll(thinned(df.repartition(5), ["id"], 1_000, 10_000)).isEmpty()
    assert thinned(df, ["id"], 20_000, 10_000).count() == 10_000


def test_staged_rows_come_back(spark):
    df = spark.range(5).select("id", F.array("id").alias("l"))
    assert staged(df, "t").exceptAll(df).isEmpty()
    assert staged(df.filter("id > 9"), "t").collect() == []


NAMES = (
    "text_id", "class", "class_id", "kept", "md5", "spans", "score", "keep", "value", "row_id", "s", "a", "b", "bucket",
    "ids", "start", "offset", "features", "code", "n", "owner", "repository",
)


@pytest.mark.parametrize("operator", [packing.pack, pii.find, probminhash.near_copies, quality.score, secrets.scan])
def test_extra_columns_do_not_clash(documents, operator):
    docs = documents([(1, "some words of a text, token=abcdef12"), (2, None), (2, None)])
    extra = docs.withColumns({name: F.lit("clash") for name in NAMES})
    plain, clashing = operator(docs), operator(extra)
    assert clashing.columns == plain.columns
    assert sorted(map(str, clashing.collect())) == sorted(map(str, plain.collect()))


def test_redaction_keeps_clashing_columns(documents):
    docs = documents([(1, "mail a@b.cc"), (2, None)]).withColumn("spans", F.lit("clash"))
    rows = sorted(pii.redact(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.text, r.spans) for r in rows] == [("mail [EMAIL]", "clash"), (None, "clash")]
