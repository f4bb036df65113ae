"""Benchmark items in documents, against sets of shingles."""

import random

from gainsay.llm import containment
from gainsay.llm.shingles import word_shingles

ITEMS = "item_id bigint, text string, containment string"


def _case():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([5, 8, 20, 60, 64, 65, 300]))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "three word item"), (None, say(30)), (7, items[7][1])]
    rows = []
    for i in range(120):
        text = say(rng.choice([0, 3, 30, 400, 4000]))
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(4)):  # some with edits
                if item:
                    item[rng.randrange(len(item))] = rng.choice(["zzz", "W1"])
            cut = text.split()
            at = rng.randrange(len(cut) + 1)
            text = "\n".join([*cut[:at], *item, *cut[at:]])
        rows.append((i, text))
    rows += [(500, None), (501, "three  Word\nITEM"), (502, "not three word item"), (3, rows[3][1]), (None, items[20][1])]
    return rows, items


def _expected(rows, items, threshold=0.8):
    out = []
    for doc, text in rows:
        whole = word_shingles(text)
        for item, wanted in items:
            exact = word_shingles(wanted)
            if exact and len(exact & whole) / len(exact) >= threshold:
                out.append((doc, item, len(exact & whole) / len(exact), len(exact)))
    return sorted(out, key=repr)


def test_pairs_are_those_of_all_pairs(spark, documents):
    rows, items = _case()
    table = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    docs = documents(rows).withColumnRenamed("source", "item_id")
    for block in (1 << 19, 300):  # all items at once, and in several passes
        found = containment.contained(docs, table, block_shingles=block).collect()
        assert sorted(map(tuple, found), key=repr) == _expected(rows, items)
        clean = containment.without_items(docs, table, block_shingles=block).collect()
        bad = {(d, t) for d, t in rows for x in [word_shingles(t)] if any(e and len(e & x) / len(e) >= 0.8 for e in (word_shingles(i) for _, i in items))}
        assert sorted(((r.doc_id, r.text) for r in clean), key=repr) == sorted((r for r in rows if r not in bad), key=repr)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b c d e f", "")], ITEMS)
    assert containment.contained(documents([]), one).collect() == []
    assert containment.contained(documents([(1, "a b c d e f")]), none).collect() == []
    assert containment.without_items(documents([(1, "a b c d e f")]), none).count() == 1


def test_short_items_in_long_documents_are_all_found(spark, documents):
    """Items of one to five shingles, whole or at the threshold, in texts of many words: none is missed."""
    items, rows = [], []
    for seed in range(3):
        rng = random.Random(seed)
        say = lambda n: [f"s{seed}w{rng.randrange(5000)}" for _ in range(n)]
        own = [(1000 * seed + i, " ".join(say(5 + i % 5))) for i in range(300)]
        items += [*own, own[7]]
        for n in range(20):
            words = say(3000)
            for _, item in rng.sample(own, 20):
                item = item.split()
                if len(item) == 9 and rng.random() < 0.5:
                    item[rng.choice([0, -1])] = "other"  # four of five shingles stay
                at = rng.randrange(len(words))
                words[at:at] = item
            rows.append((100 * seed + n, " ".join(words)))
    expected = _expected(rows, items)
    table = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    found = containment.contained(documents(rows).repartition(8), table).collect()
    assert len(expected) > 1000 and sorted(map(tuple, found), key=repr) == expected
