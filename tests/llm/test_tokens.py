"""Tokens, packing and record files: exact round trips."""

import random
import sys
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gainsay.llm import common, packing, records, tokens
from gainsay.llm.common import shared_folder

TEXTS = [
    "Plain words, and more words. And MORE",
    None,
    "",
    " \n ",
    "don't 12,345 a~b ~ <|endoftext|>x é́ İstanbul ΣΑΣ ½ \x1c\x85 漢字。 ﬁ ſ",
    "été Été ÉTÉ, naïve. straße",
    "long " * 9000,
    "été Été ÉTÉ, naïve. straße",
]


@pytest.fixture(scope="module")
def expected():
    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids(expected):
    rng = random.Random(5)
    letters = "abcdeéßñÜ.,!~'-1 \n\t"
    texts = [t or "" for t in TEXTS] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)
    ]
    encoder = tokens.Encoder(tokens.default_path(), generation_bytes=5_000)
    for _ in range(2):
        found = encoder.encode([t.encode() for t in texts])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [expected(t) for t in texts]


def test_letters_with_marks_give_the_tokenizers_ids(expected):
    rng = random.Random(9)
    words = [f"{a}{''.join(rng.sample(tokens._LETTERS, 3))}{a}" for a in tokens._LETTERS]
    words += [word + "".join(rng.sample(tokens._MARKS, rng.randrange(1, 4))) for word in words]
    words += ["漢字。", "漢字.", "ﬁ", "İi.", "ΌΔΟΣ", "x'S", "it's.", "a1.", "-a", "a-b", "½.", "a\u0301.", "=\u0338", "a=\u0338"]
    encoder = tokens.Encoder(tokens.default_path())
    found = encoder.encode([word.encode() for word in words] + [" \n".join(words).encode(), b"a\xff\xc3 b."])
    wanted = [expected(word) for word in words] + [expected(" ".join(words)), expected("a\ufffd\ufffd b.")]
    assert encoder._direct
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == wanted


def test_all_forms_of_a_word_share_an_entry():
    encoder = tokens.Encoder(tokens.default_path())
    encoder.encode([b"Straetown straetown, STRAETOWN. straetown%%% Straetown!? straetown$$$", b"straetown:"])
    assert [word for word in encoder._young if b"strae" in word.lower()] == [b"straetown"]


@pytest.mark.parametrize("token", ["foo", "foo!", "!?"])
def test_added_tokens_within_words_are_found(token, tmp_path):
    tokenizer = Tokenizer.from_file(tokens.default_path())
    tokenizer.add_tokens([token])
    tokenizer.save(str(tmp_path / "added.json"))
    text = "a food foo! bar!? foo."
    found = tokens.Encoder(str(tmp_path / "added.json")).encode([text.encode()])
    assert np.frombuffer(found[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_the_cache_is_bounded_and_freed_by_other_tasks():
    encoder = tokens.Encoder(tokens.default_path(), generation_bytes=1 << 20)
    for i in range(40):
        encoder.encode([" ".join(f"w{i}x{j}" + "y" * 40 for j in range(500)).encode()])
    encoder.encode([b"z" * 5_000_000])
    assert not any(len(word) > 1000 for word in encoder._young)
    held = sum(len(k) + len(v) for table in (encoder._young, encoder._old) for k, v in table.items())
    assert held < 3 << 20
    first = tokens.encoder(tokens.default_path())
    common.begin("tokens")
    assert tokens.encoder(tokens.default_path()) is first
    common.begin("another")
    assert tokens._encoders == {} and tokens.encoder(tokens.default_path()) is not first


def test_what_a_worker_holds_is_small():
    encoder, calls = tokens.Encoder(tokens.default_path()), []
    letters = [chr(97 + i) for i in range(26)]
    for first in letters:
        # 26 x 26,000 words of letters that come once.
        ends = (f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:2])
        encoder.encode([" ".join(f"{first}{end}q" for end in ends).encode()])
    tables = (encoder._young, encoder._old)
    held = sum(sys.getsizeof(table) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in table.items()) for table in tables)
    assert held < 80 << 20
    whole = encoder._tokenizer.encode_batch_fast
    encoder._tokenizer = SimpleNamespace(encode_batch_fast=lambda texts, **o: calls.append(len(texts)) or whole(texts, **o))
    encoder.encode([" ".join(f"w{i}" for i in range(10_000)).encode()])
    assert len(calls) > 1 and max(calls) <= 64


def test_a_task_of_another_operator_gives_arrows_memory_back(monkeypatch):
    calls = []
    pool = SimpleNamespace(release_unused=lambda: calls.append(owner))
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    for owner in ("one", "one", "other", "one"):
        common.begin(owner)
    assert calls == ["one", "other", "one"]


@pytest.mark.parametrize("block_tokens", [1 << 20, 500])
def test_packing_keeps_every_id_once(documents, expected, block_tokens):
    rng = random.Random(6)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(700))) for _ in range(60)]
    docs = documents(list(enumerate(texts))).withColumnRenamed("lang", "sequence_id").repartition(3)
    rows = packing.pack(docs, block_tokens=block_tokens).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length > 0
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r.start)
        whole = [*expected(text), 2]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == whole
        assert {r.doc_tokens for r in own} == {len(whole)}
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        size = sum(r.length for r in own)
        assert size <= 4096 and size & (size - 1) == 0
        assert len({r.step_group for r in own}) == 1


def test_windows_come_from_their_tier_and_gaps_from_shorter_ones():
    packer = packing.Packer((512, 1024))
    for i, n in enumerate([900, 100, 24, 500, 12]):
        packer.add(i, bytes(4 * n))
    windows = packer.close(last=True)
    assert [[(p[2], p[0]) for p in w] for w in windows] == [[(0, 900), (1, 100), (2, 24)], [(3, 500), (4, 12)]]


def test_step_groups_are_balanced():
    windows = [[(4096, 0, 0, 0, b"", 0)]] * 10 + [[(512, 0, 0, 0, b"", 0)]] * 80
    chosen = packing.balance(windows, 16384)
    loads = defaultdict(int)
    for window, group in zip(windows, chosen):
        loads[group] += window[0][0]
    assert len(loads) == 5 and max(loads.values()) - min(loads.values()) <= 512


def test_records_round_trip_in_order(spark, documents, expected):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice"), (-5, "minus")]
    random.Random(7).shuffle(rows)
    folder = shared_folder(spark, "test")
    records.write_records(documents(rows).repartition(4), folder)
    back = records.read_records(spark, folder).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    back.sort(key=lambda r: r.start)
    assert [r.doc_id for r in back] == [i for i, _ in ordered]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in back] == [[*expected(t), 1] for _, t in ordered]
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()
    shuffled = records.read_shuffled(spark, folder, seed=1, parts=3).collect()
    assert sorted(shuffled, key=lambda r: r.start) == back
    assert [r.start for r in shuffled] != [r.start for r in back]


def test_rows_of_one_id_fill_several_files(spark, documents):
    rows = [(None, f"text {i}") for i in range(400)] + [(7, f"other {i}") for i in range(400)]
    docs = documents(rows).withColumn("ids", F.lit("mine")).withColumn("start", F.lit(1)).repartition(4)
    folder = shared_folder(spark, "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = records.write_records(docs, folder)["files"]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files) == 4 and max(f["documents"] for f in files) < 400
    back = records.read_records(spark, folder).collect()
    back.sort(key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None] * 400 + [7] * 400
    assert [r.start for r in back] == np.cumsum([0, *(r.n_tokens for r in back)])[:-1].tolist()


def test_records_of_an_empty_table(spark, documents):
    folder = shared_folder(spark, "empty")
    assert records.write_records(documents([]), folder)["files"] == []
    assert records.read_records(spark, folder).collect() == []
    assert packing.pack(documents([])).collect() == []


def test_damaged_frames_are_found():
    payload = records.payload(7, np.arange(5), 2)
    good = b"".join(records.frames([payload, payload]))
    assert records.payloads(good) == [payload, payload]
    assert records.document(payload) == (7, np.arange(5, dtype="<u4").tobytes())
    for place in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[place] ^= 1
        with pytest.raises(records.BadRecord):
            records.payloads(bytes(bad))
    with pytest.raises(records.BadRecord):
        records.payloads(good[:-3])


def test_crc_of_the_digest_query(documents, expected):
    from gainsay.llm.queries import digest_pieces

    row = digest_pieces(packing.pack(documents([(1, "a b c")]))).first()
    assert row.ids_crc32 == zlib.crc32(np.array([*expected("a b c"), 2][: row.length], "<u4").tobytes())
