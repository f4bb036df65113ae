"""Near copies against all pairs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from gainsay.llm import probminhash, shingles


def _weights(text):
    words = text.lower().split()
    found = Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else {}
    return {s: 1 + math.log(n) for s, n in found.items()}


def _similarity(w, v):
    """Probability Jaccard by its definition."""
    every = w.keys() | v.keys()
    return sum(
        1 / sum(max(w.get(e, 0) / w[d], v.get(e, 0) / v[d]) for e in every) for d in w.keys() & v.keys()
    )


def _expected(rows, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    weights = [_weights(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if weights[i].keys() & weights[j].keys() and _similarity(weights[i], weights[j]) >= threshold:
            parent[root(i)] = root(j)
    classes = {}
    for doc, text in rows:
        classes.setdefault(root(texts.index(text or "")), []).append(doc)
    return {
        (doc, text or ""): (min((d for d in classes[root(texts.index(text or ""))] if d is not None), default=None), len(classes[root(texts.index(text or ""))]))
        for doc, text in rows
    }


def _edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def _corpus():
    rng = random.Random(11)
    rows = []
    for _ in range(25):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(40, 160))]
        rows += [_edited(rng, base, e) for e in rng.choices([0, 0, 1, 2, 3, 5, 9, 20], k=rng.randrange(1, 9))]
    hub = [f"h{i}" for i in range(200)]  # many copies that are near the original but not each other
    rows += [" ".join(hub)] + [_edited(rng, hub, 4) for _ in range(60)]
    line = "one line that many documents share word for word in the middle of them"
    rows += [f"{_edited(rng, ['x'] * 30, 30)} {line} {_edited(rng, ['x'] * 30, 30)}" for _ in range(40)]
    rows += ["same words again " * n for n in (1, 3, 40, 41, 80)] + ["", " \n", "one", "two words", "ONE"]
    rows = list(enumerate(rows)) + [(900, None), (901, None), (None, rows[3]), (None, "nowhere else at all, this"), (5, rows[40]), (5, rows[40]), (5, rows[40])]
    rng.shuffle(rows)
    return rows


def test_classes_are_those_of_all_pairs(documents):
    rows = _corpus()
    docs = documents(rows).withColumnRenamed("source", "class_id").repartition(3)
    found = probminhash.near_copies(docs).collect()
    expected = _expected(rows)
    texts = {}
    for _, t in rows:
        from hashlib import md5

        texts[md5((t or "").encode()).hexdigest()] = t or ""
    got = sorted(((r.doc_id, texts[r.md5], r.class_id, r.class_size) for r in found), key=repr)
    want = sorted(((d, t or "", *expected[d, t or ""]) for d, t in rows), key=repr)
    assert got == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len({(r.class_id, r.class_size, texts[r.md5] if r.class_id is None else "") for r in found})
    assert all(r.doc_id == r.class_id for r in kept)


def test_empty_table(documents):
    assert probminhash.near_copies(documents([])).collect() == []


def test_exact_similarity():
    rng = random.Random(3)
    for _ in range(30):
        a = " ".join(rng.choice("abc") for _ in range(rng.randrange(5, 60)))
        b = " ".join(rng.choice("abc") for _ in range(rng.randrange(5, 60)))
        of, ids, counts = shingles.weighted_sets([a.encode(), b.encode()])
        w = probminhash.weights(counts)
        got = probminhash.probability_jaccard(ids[of == 0], w[of == 0], ids[of == 1], w[of == 1])
        assert got == pytest.approx(_similarity(_weights(a), _weights(b)))


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = random.Random(5)
    base = [f"w{i % 90}" for i in range(150)]
    texts = [" ".join(base), _edited(rng, base, 3), _edited(rng, base, 10)]
    owners, _ = probminhash.signatures([t.encode() for t in texts], 4000)
    for other in (1, 2):
        agree = np.mean(owners[0] == owners[other])
        assert agree == pytest.approx(_similarity(_weights(texts[0]), _weights(texts[other])), abs=0.03)


def test_sketches_tell_in_how_many_components_texts_differ(spark):
    rng = np.random.default_rng(4)
    one = rng.integers(0, 1 << 48, size=(40, 30)).astype(np.uint64)
    other = np.where(rng.random(one.shape) < 0.4, one, one + np.uint64(1))
    a, b = probminhash.sketches(one), probminhash.sketches(other)
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<bigint>, b array<bigint>")
    got = [r[0] for r in df.select(probminhash.differing(df.a, df.b)).collect()]
    low = lambda x: (shingles.mix(x.copy()) & np.uint64(0xFF)).astype(int)
    assert got == (low(one) != low(other)).sum(axis=1).tolist()


def test_a_lost_link_is_rare():
    """The chance that a pair at the threshold shares no bucket."""
    assert (1 - 0.8**probminhash.ROWS) ** probminhash.BANDS < 1e-4


def test_links_at_the_very_threshold(documents):
    """Exactly four of five shingles are common: linked, however the sum of floats falls; one less is not."""
    at = [(94, [10, 50]), (76, [2, 30]), (58, [0, 20]), (49, [20]), (184, [10, 40, 70, 100]), (139, [10, 40, 70])]
    below = [(93, [10, 50]), (75, [2, 30])]
    rows = []
    for n, (length, edits) in enumerate(at + below):
        words = [f"t{n}x{i}" for i in range(length)]
        other = [f"t{n}y{i}" if i in edits else w for i, w in enumerate(words)]
        a, b = _weights(" ".join(words)), _weights(" ".join(other))
        share = (5 * len(a.keys() & b.keys()), 4 * len(a.keys() | b.keys()))
        assert share[0] == share[1] if n < len(at) else share[0] < share[1]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    found = {r.doc_id: r.class_id for r in probminhash.near_copies(documents(rows)).collect()}
    assert found == {i: i - i % 2 if i < 2 * len(at) else i for i, _ in rows}
