"""The registered queries on the smallest tables, with SQL where there is some; and the pipeline's stages."""

from collections import Counter
from pathlib import Path

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from gainsay.llm import containment, packing, pii, probminhash, toxicity
from gainsay.llm.common import read, staged
from gainsay.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="benchmark tables are not here")


def test_all_are_registered():
    names = contract.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    _, problem = compare(spark, connect(SF_DIR), SF_DIR, QUERIES[name], ORACLE[name])
    assert problem is None


@pytest.mark.parametrize("name", ["op1_ownership_secrets", "op9_boosted_pii", "op10_weak_toxicity", "op6_weak_label_quality", "op4_probminhash_near_dedup"])
def test_one_row_per_document(spark, name):
    rows = QUERIES[name](spark, SF_DIR).select("doc_id").collect()
    assert Counter(rows) == Counter(read(spark, SF_DIR, "documents").select("doc_id").collect())


def test_every_stage_takes_effect_on_what_came_before(spark):
    docs = read(spark, SF_DIR, "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF_DIR), name)
        seen.append(name)
        ids, kept = {r.doc_id for r in docs.collect()}, {r.doc_id for r in after.collect()}
        if name != "packing":
            assert after.columns == docs.columns
        if name == "toxicity":
            scores = toxicity.score(docs, read(spark, SF_DIR, "labels")).collect()
            assert kept == {r.doc_id for r in scores if not r.predicted}
        elif name == "near_dedup":
            assert kept == {r.class_id for r in probminhash.near_copies(docs).collect()}
            assert after.count() == len(kept)
        elif name == "decontamination":
            bad = containment.contained(docs, read(spark, SF_DIR, "benchmark")).collect()
            assert kept == ids - {r.doc_id for r in bad}
        elif name == "personal_data":
            assert kept == ids
            assert not any(pii.fixed(r.text) for r in after.collect())
            assert all(r.n_chars == len(r.text) for r in after.collect())
        else:
            assert Counter(map(tuple, after.collect())) == Counter(map(tuple, packing.pack(docs).collect()))
        docs = after
    assert seen == ["toxicity", "near_dedup", "decontamination", "personal_data", "packing"]


def test_stages_take_odd_rows_and_clashing_columns(spark, documents):
    rows = [(1, None), (2, ""), (3, "plain text here"), (3, "plain text here"), (3, "another text"), (None, "no id at all")]
    names = ["_pipeline_key", "_kept_id", "_kept_key", "md5", "text_id", "kept", "class_id", "spans", "score", "predicted", "item_id", "toxic"]
    docs = documents(rows).withColumns({name: F.concat(F.lit(name), F.lit(" mine")) for name in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        kept = after.collect()
        assert after.columns == docs.columns, name
        assert all(r[c] == f"{c} mine" for r in kept for c in names), name
        expected = [(1, ""), (3, "plain text here"), (3, "another text"), (None, "no id at all")]
        if name != "near_dedup":
            expected = [(i, t or "") for i, t in rows]
        assert Counter((r.doc_id, r.text or "") for r in kept) == Counter(expected), name
    pieces = corpus_pipeline.pack(spark, docs, SF_DIR)
    assert pieces.columns == packing.pack(documents(rows)).columns
    assert Counter(r.doc_id for r in pieces.filter("start = 0").collect()) == Counter(i for i, _ in rows)
    empty = documents([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).collect() == [], name
