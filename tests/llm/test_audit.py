"""Filter interaction: every order walked document by document, and the pieces on their own."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gainsay.llm import audit

LABELS = "doc_id bigint, quality int, toxic int"


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > smallest[text],
        }
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, documents in parts.items():
        shapley = defaultdict(int)
        lines = []
        for order in audit.ORDERS:
            left = documents
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                shapley[f] += len(gone)
                failing = [d for d in documents if d[0][f]]
                lines.append((part, order, step, len(left), len(gone), len(failing) - len(gone),
                              sum(sum(d[0].values()) == 1 for d in failing), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*line, shapley[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def _text(rng):
    words = [rng.choice(["a", "b", "TITLE", "né", f"w{rng.randrange(400)}", "$5"][: rng.choice([2, 5, 6])]) for _ in range(rng.choice([0, 3, 99, 100, 150]))]
    return rng.choice([" ", "\n", "\t ", "  "]).join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_every_order(spark, seed):
    rng = random.Random(seed)
    texts = [_text(rng) for _ in range(30)] + [None, ""]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += rows[:10]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns(
        {c: F.lit("clash") for c in ("mask", "part", "good", "documents", "spread", "text_key")}
    )
    marks = spark.createDataFrame(labels, LABELS).withColumn("good", F.lit("clash"))
    found = audit.audit(docs, marks)
    assert sorted(map(tuple, found.collect())) == brute(rows, labels)


def test_no_documents(spark, documents):
    empty = spark.createDataFrame([], LABELS)
    assert audit.audit(documents([]), empty).collect() == []
    assert audit.audit(documents([(1, None)]), empty).count() == 600


def test_walk_equals_counting():
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 50, size=(3, audit.SETS, 3))
    states = audit.walk(cells)
    for chosen in range(audit.SETS):
        left = [m for m in range(audit.SETS) if not m & chosen]
        assert (states[chosen] == cells[:, left].sum(axis=1)).all()


def test_words_of_long_texts():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "  ", "\x1c", "é", "x" * 30]) for _ in range(rng.randrange(200))).encode()
        words = text.split()
        piece, audit._PIECE = audit._PIECE, rng.randrange(1, 40)
        try:
            assert audit.count_words(text, limit=max(1, len(text) // 3)) == (len(words), len(set(words)))
        finally:
            audit._PIECE = piece


def test_one_very_long_text():
    text = b" ".join(b"%d" % i for i in range(3_000_000))
    assert len(text) > 2 * audit.WORD_BYTES
    assert audit.count_words(text) == (3_000_000, 3_000_000)
