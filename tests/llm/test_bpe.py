"""Byte-level BPE: ids as the library gives match by match, and every byte back."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gainsay.llm import bpe

PATTERN = bpe.default_pattern()


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.default_path(), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def brute(text, ranks):
    """Merge the lowest-ranked neighbours of each match, one at a time."""
    ids = []
    for match in regex.findall(PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            pairs = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(pairs)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        ids += [ranks[part] for part in parts]
    return ids


@pytest.fixture(scope="module")
def small():
    """Cuts wherever it may, every four characters."""
    return bpe.Encoding(bpe.default_path(), PATTERN, piece_chars=4)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'ab1.sвж中。 　\x1c​"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_are_those_of_every_match(ranks, small, text):
    whole = bpe.encoding(bpe.default_path(), PATTERN)
    expected = brute(text, ranks)
    assert whole.encode(text).tolist() == expected
    assert small.encode(text).tolist() == expected
    assert whole.decode(np.array(expected, dtype="<u4")) == text.encode()


@pytest.mark.parametrize("text", ["  " * 5000, "a" + " " * 9000 + "b", "\n" * 5000 + " x", "x \n" * 20000, " " * 4096 + "　" * 4096 + "1",
                                  "it's" * 30000, "中文。" * 30000, "ab1" * 40000])
def test_long_texts(ranks, text):
    assert bpe.encoding(bpe.default_path(), PATTERN).encode(text).tolist() == brute_fast(text, ranks)


def brute_fast(text, ranks, known={}):  # noqa: B006 - a cache
    """As ``brute`` with each distinct match once; runs of one character by halves of known results are not needed."""
    ids = []
    for match in regex.findall(PATTERN, text):
        if match not in known:
            known[match] = brute(match, ranks) if len(match) < 100 else [
                *bpe.encoding(bpe.default_path(), PATTERN)._model._encode_single_piece(match)
            ]
        ids += known[match]
    return ids


def test_a_run_that_the_library_cannot_take():
    text = "a" + " " * 1_000_000 + "b" + "\n" * 500_000
    model = bpe.encoding(bpe.default_path(), PATTERN)
    ids = model.encode(text)
    assert model.decode(ids) == text.encode()
    assert ids[0] == model.encode("a")[0] and model.encode(" b").tolist()[0] in ids.tolist()


def test_odd_rows(spark, documents):
    rng = random.Random(3)
    long = " ".join(rng.choice(["lorem", "ipsum,", "<|endoftext|>", "42"]) for _ in range(100_000))
    rows = [(1, None), (2, ""), (None, "no id"), (4, "same"), (4, "same"), (5, long)]
    docs = documents(rows).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(-1), "decoded": F.lit("clash")})
    found = bpe.decode(bpe.encode(docs))
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, bytes(r.decoded).decode()) for r in found.collect()))
    assert got == sorted((i or 0, t or "") for i, t in rows)
    for r in found.collect():
        assert r.n_tokens * 4 == len(r.ids)
    digests = {r.doc_id: r for r in bpe.digests(found).collect()}
    assert digests[1].n_tokens == 0 and digests[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert digests[5].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert bpe.decode(bpe.encode(documents([]))).collect() == []


def test_bytes_need_not_be_text(spark, ranks):
    half = ranks["é".encode()[:1]]
    rows = spark.createDataFrame([(1, struct.pack("<I", half)), (2, None)], "doc_id bigint, ids binary")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(rows).collect()} == {1: b"\xc3", 2: b""}
