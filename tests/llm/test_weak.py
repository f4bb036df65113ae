"""Label model, linear scorer, toxicity and quality."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gainsay.llm import quality, toxicity, weak

LABELS = "doc_id bigint, toxic int, quality int, score int"


def _voted(rng, n, accuracies, spoken=0.8, prior=0.3, copies=0):
    truth = (rng.random(n) < prior).astype(int)
    votes = np.full((n, len(accuracies) + copies), -1, dtype=np.int8)
    for j, accuracy in enumerate(accuracies):
        says = np.where(rng.random(n) < accuracy, truth, 1 - truth)
        votes[:, j] = np.where(rng.random(n) < spoken, says, -1)
    for j in range(copies):
        votes[:, len(accuracies) + j] = votes[:, 0]
    return truth, votes


def _patterns(votes):
    codes, counts = np.unique(weak.encode(votes), return_counts=True)
    return weak.decode(codes, votes.shape[1]), counts.astype(float)


def test_codes_go_back_and_forth():
    votes = np.random.default_rng(0).integers(-1, 2, size=(50, 7))
    assert (weak.decode(weak.encode(votes), 7) == votes).all()


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(1)
    wanted = [0.9, 0.8, 0.7, 0.85, 0.6]
    truth, votes = _voted(rng, 40_000, wanted)
    patterns, counts = _patterns(votes)
    model = weak.fit(patterns, counts, weak.one_vote_each)
    found = model.accuracies()
    assert [found[j] for j in range(5)] == pytest.approx(wanted, abs=0.05)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.88


def test_copies_of_a_labeller_are_grouped():
    rng = np.random.default_rng(2)
    truth, votes = _voted(rng, 20_000, [0.65, 0.85, 0.85], copies=2)
    patterns, counts = _patterns(votes)
    model = weak.fit(patterns, counts, weak.one_vote_each, anchors=(votes[:200], truth[:200]))
    assert (0, 3, 4) in model.groups
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.84


def test_linear_scorer():
    rng = random.Random(3)
    rows, labels = [], []
    for _ in range(600):
        bad = rng.random() < 0.3
        words = {rng.randrange(100, 900) for _ in range(20)} | ({rng.randrange(5)} if bad else set())
        rows.append(np.array(sorted(words), dtype=np.uint64))
        labels.append(float(bad))
    model = weak.train(rows, np.array(labels), np.arange(5, dtype=np.uint64))
    score = model.score(3, np.array([0, 0, 2, 2]), np.array([3, 3, 4, 500], dtype=np.uint64))
    assert score[0] > 0.7 > 0.3 > score[1] and score[2] > 0.7
    empty = weak.train([], np.zeros(0), np.zeros(0, dtype=np.uint64))
    assert empty.score(2, np.zeros(0, int), np.zeros(0, np.uint64)).tolist() == [0.5, 0.5]


def _toxic_case(n=900):
    rng = random.Random(4)
    syllables = ["an", "er", "on", "th", "re", "st", "ing", "ou", "ti", "ble", "ea", "sh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5)))
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = [word() for _ in range(rng.randrange(5, 120))]
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Grobian", "vilify" + word(), "louse,"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), 1, 0))
    return rows, labels


def test_held_out_rows_are_scored_well_without_their_labels(spark, documents):
    rows, labels = _toxic_case()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    extra = [(5000, None), (5001, ""), (None, "no id"), (3, rows[3][1])]
    docs = documents(rows + extra).withColumnRenamed("lang", "score").repartition(3)
    odd = [(7, None, 1, 0), (8, 5, 1, 0), (None, 1, 1, 0), (99999, 1, 1, 0), labels[3]]
    table = spark.createDataFrame(labels + odd, LABELS)
    found = toxicity.score(docs, table).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows + extra)
    truth = {i: t for i, t, *_ in labels}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    right = [r.predicted == truth[r.doc_id] for r in found if r.doc_id in held]
    assert np.mean(right) > 0.98
    # Other labels for the held-out rows change nothing.
    turned = spark.createDataFrame([(i, 1 - t if i in held else t, q, s) for i, t, q, s in labels] + odd, LABELS)
    again = {(r.doc_id, r.score) for r in toxicity.score(docs, turned).collect()}
    assert again == {(r.doc_id, r.score) for r in found}
    kept = toxicity.without_toxic(docs, table).collect()
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in found if not r.predicted)
    assert kept[0].asDict().keys() == set(docs.columns)


def test_toxicity_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(documents([]), none).collect() == []
    assert [r.predicted for r in toxicity.score(documents([(1, "a b")]), none).collect()] == [0]


def test_quality_tells_junk_from_prose_without_labels(documents):
    rng = random.Random(6)
    syllables = ["an", "er", "on", "th", "re", "st", "ing", "ou", "ti", "ble", "ea", "sh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    rows, good = [], {}
    for i in range(800):
        words = [word() for _ in range(rng.randrange(4, 200))]
        junk = i % 6
        if junk == 0:
            words = [words[0]] * max(len(words), 20)
        elif junk == 1 and i % 4 == 1:
            words = [w.upper() + "!!" for w in words]
        elif junk == 2 and i % 4 == 2:
            words = [w + rng.choice(["***", "%%%", "$$$"]) for w in words]
        else:
            words = [w + "." * (k % 9 == 8) for k, w in enumerate(words)]
            good[i] = True
        rows.append((i, " ".join(words)))
    rows += [(5000, None), (5001, ""), (None, rows[3][1]), (3, rows[3][1])]
    found = quality.score(documents(rows).withColumnRenamed("source", "score")).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    right = [r.keep == good.get(r.doc_id, False) for r in found if r.doc_id is not None and r.doc_id < 800]
    assert np.mean(right) > 0.97
    assert quality.score(documents([])).collect() == []
