"""Conversations: formatted, masked and read back."""

import random

from pyspark.sql import functions as F

from gainsay.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, start int, segment string"
NASTY = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "a\\n\nb", "<", "<<||", "|im_end|>", "", None, "\\|", "💬é"]


def _ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {c: sorted(v, key=key) for c, v in out.items()}


def _rows():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\\n\nb", "<|x"]), rng.choice(NASTY)) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)]  # several chunks
    rows += [(None, 1, "assistant", "no id"), (None, None, "user", "no turn"), (7, 1, "user", "tie"), (7, 1, "user", "tie")]
    # Ties that escaping or an end mark would put in another order.
    rows += [(8, 1, "user", t) for t in ("ab!", "ab", "<|b", "<a", "\\", "]")]
    return rows


def test_round_trip_and_masks(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], TURNS).repartition(5)
    formatted = chat.segments(df)
    back = {}
    for r in chat.parsed(formatted).collect():
        back.setdefault(r.conv_id, []).append(r)
    expected = _ordered(rows)
    assert back.keys() == expected.keys()
    for conv, own in back.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        assert [(r.role, r.text) for r in own] == [(r[2] or "", r[3] or "") for r in expected[conv]]
        assert [r.loss for r in own] == [(r[3] or "") if r[2] == "assistant" else None for r in expected[conv]]


def test_every_assistant_turn_is_an_example_with_all_turns_before_it(spark):
    rows = [r for r in _rows() if r[0] != 100]
    formatted = chat.segments(spark.createDataFrame([(*r, 9, "x") for r in rows], TURNS))
    texts = chat.example_texts(chat.examples(formatted), formatted).collect()
    expected = _ordered(rows)
    assert len(texts) == sum(r[2] == "assistant" for r in rows)
    for e in texts:
        turns = expected[e.conv_id]
        assert turns[e.target][2] == "assistant"
        assert len(e.text) == e.example_chars
        assert e.text.count("<|im_start|>") == e.target + 1
        reply = e.text[e.loss_start : e.loss_end]
        assert reply == (turns[e.target][3] or "").replace("\\", "\\\\").replace("<|", "<\\|")
        assert e.reply == (turns[e.target][3] or "")
        assert e.text[e.context_chars :].startswith("<|im_start|>assistant\n")
        assert e.text[e.loss_end :] == "<|im_end|>\n"


def test_empty_table(spark):
    formatted = chat.segments(spark.createDataFrame([], TURNS))
    assert formatted.collect() == [] and chat.examples(formatted).collect() == []


def test_every_example_is_written_out_in_bounded_pieces(spark):
    rows = [r for r in _rows() if r[0] != 100] + [(100, t, "assistant" if t % 3 else "user", f"turn {t} <|im_start|>") for t in range(200)]
    formatted = chat.segments(spark.createDataFrame([(*r, 9, "x") for r in rows], TURNS))
    pieces = chat.written(chat.examples(formatted), formatted, piece_chars=500).collect()
    whole = {}
    for r in formatted.orderBy("position").collect():
        whole.setdefault(r.conv_id, []).append(r.segment)
    longest = max(len(s) for own in whole.values() for s in own)
    texts = {}
    for p in sorted(pieces, key=lambda p: p.piece):
        text = texts.get((p.conv_id, p.target), "")
        assert p.piece_start == len(text) and 0 < len(p.piece_text) <= 500 + longest
        texts[p.conv_id, p.target] = text + p.piece_text
    assert len(texts) == sum(r[2] == "assistant" for r in rows) == sum(p.last for p in pieces)
    assert all(text == "".join(whole[conv][: target + 1]) for (conv, target), text in texts.items())
    assert sum(p.conv_id == 100 for p in pieces) > 1000


def test_the_query_reads_written_examples(spark, monkeypatch, tmp_path):
    from gainsay.llm import queries

    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b<|"), (1, 2, "user", "c"), (1, 3, "assistant", "d")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    def run():
        return next(r for r in queries.op8_prefix_target_chat(spark, str(tmp_path)).collect() if r.conv_id == 1)

    right, written = run(), chat.written
    assert (right.n_examples, right.loss_chars) == (2, 4)
    monkeypatch.setattr(chat, "written", lambda *a: written(*a).withColumn("piece_text", F.replace("piece_text", F.lit("\na<|"), F.lit("\nax<|"))))
    longer = run()
    assert (longer.context_chars, longer.example_chars) == (right.context_chars + 2, right.example_chars + 2)
    assert longer.loss_sha256 != right.loss_sha256
