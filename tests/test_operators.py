"""Gaps, window presence, gates and trees against brute force."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gainsay.operators import gaps, presence
from gainsay.operators.rows import only_cases_with, split_failures, without_bad_files
from gainsay.operators.tree import key_failures, key_paths, with_subkey_counts

# --- gaps --------------------------------------------------------------------------------------


def _expected_gaps(numbers):
    ordered = sorted(set(numbers))
    return {(a, b, b - a - 1) for a, b in zip(ordered, ordered[1:]) if b - a > 1}


def _found_gaps(spark, by_source):
    rows = [(s, n) for s, numbers in by_source.items() for n in numbers]
    df = spark.createDataFrame(rows, "s string, n bigint")
    found = gaps.record_gaps(df, by=["s"], number="n").collect()
    assert len(found) == len(set(found))
    return {s: {(r.previous, r.current, r.missing) for r in found if r.s == s} for s in by_source}


def test_gaps_of_small_sequences(spark):
    sources = {
        "none": [1, 2, 3], "ten": [1, 12], "nine": [1, 11], "repeats": [1, 1, 2], "one": [5],
        "word": [62, 63, 64, 65, 128, 191, 192], "far": [0, 2**22, 2**22 + 1, 2**40, 2**62],
        "negative": [-130, -64, -1, 0, 70],
    }
    assert _found_gaps(spark, sources) == {s: _expected_gaps(n) for s, n in sources.items()}


def test_gaps_of_random_sequences(spark):
    rng = random.Random(7)
    sources = {}
    for i, spread in enumerate((100, 5_000, 10**7, 2**45, 2**63 - 1)):
        sources[f"s{i}"] = [rng.randrange(spread) for _ in range(400)]
    dense = list(range(1000, 9000))
    sources["dense"] = [n for n in dense if rng.random() > 0.01] * 2
    assert _found_gaps(spark, sources) == {s: _expected_gaps(n) for s, n in sources.items()}


def test_minor_gaps_summary_and_first_ones(spark):
    df = spark.createDataFrame([("a", 2 * n) for n in range(13)] + [("a", 100)], "s string, n bigint")
    found = gaps.record_gaps(df, by=["s"], number="n")
    assert [r.missing for r in gaps.significant(found).collect()] == [75]
    assert gaps.summarise(gaps.minor(found), ["s"]).first()[1:] == (12, 12, 1)
    first = gaps.first_gaps(gaps.minor(found), ["s"], 10).orderBy("place").collect()
    assert [r.previous for r in first] == [2 * n for n in range(10)]


# --- presence ----------------------------------------------------------------------------------

START = datetime(2024, 1, 1)
WINDOW = timedelta(minutes=5)


def _unmatched(spark, probes, events, window=WINDOW, **options):
    left = spark.createDataFrame(probes, "id int, case_id string, name string, time timestamp")
    right = spark.createDataFrame(events, "case_id string, text string, time timestamp")
    found = presence.unmatched_in_window(left, right, window=window, **options)
    return Counter(r.id for r in found.collect())


def _brute_force(probes, events, window=WINDOW):
    return Counter(
        i for i, case, name, at in probes
        if not any(
            c == case and t is not None and at - window <= t <= at + window
            and name.lower() in (text or "").lower()
            for c, text, t in events
        )
    )


def test_window_ends_are_included(spark):
    micro = timedelta(microseconds=1)
    probes = [(1, "c", "calc.exe", START)]
    for offset, hit in ((WINDOW, 1), (-WINDOW, 1), (WINDOW + micro, 0), (-WINDOW - micro, 0)):
        events = [("c", r"C:\x\CALC.EXE -k", START + offset)]
        assert len(_unmatched(spark, probes, events)) == 1 - hit


def test_texts_are_literal_and_null_holds_nothing(spark):
    probes = [(1, "c", "a_c.exe", START), (2, "c", "%.exe", START), (2, "c", "%.exe", START)]
    events = [("c", "abc.exe", START), ("c", None, START), ("c", "a_c.exe", None), ("d", "a_c.exe", START)]
    assert _unmatched(spark, probes, events) == Counter({1: 1, 2: 2})


def test_zero_window_is_equality(spark):
    probes = [(1, "c", "x", START), (2, "c", "x", START + timedelta(microseconds=1))]
    assert _unmatched(spark, probes, [("c", "x", START)], timedelta(0)) == Counter({2: 1})


@pytest.mark.parametrize("limit", [presence.BROADCAST_LIMIT_BYTES, 0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_probes_against_brute_force(spark, seed, limit):
    """Names of all lengths, shared beginnings, texts longer than a chunk; both join strategies."""
    rng = random.Random(seed)
    stems = ["a", "ab.exe", "svchost.exe", "svchost.exe2", "microsoftedge.exe", "microsoft.exe", "é ü.exe"]
    names = stems + [rng.choice("xyz") * rng.randrange(1, 20) for _ in range(10)]

    def text():
        parts = [rng.choice(names).upper() if rng.random() < 0.3 else "-" * rng.randrange(400) for _ in range(5)]
        return None if rng.random() < 0.05 else "".join(parts)

    def at(before_1970=rng.random() < 0.5):
        base = datetime(1969, 12, 31, 23) if before_1970 else START
        return base + timedelta(microseconds=rng.randrange(2 * 3600 * 10**6))

    probes = [(i, f"c{rng.randrange(2)}", rng.choice(names), at()) for i in range(150)]
    events = [(f"c{rng.randrange(2)}", text(), at()) for _ in range(60)]
    assert _unmatched(spark, probes, events, broadcast_limit=limit) == _brute_force(probes, events)


def test_a_burst_pairs_no_probe_with_an_event(spark):
    """All probes and events share one key: the join sees one row per bucket, not one per event."""
    n = 20_000
    probes = spark.range(n).selectExpr(
        "CAST(id AS INT) id", "'c' case_id", "'hot.exe' name", "TIMESTAMP '2024-01-01' + make_dt_interval(0,0,0,id/100000) time")
    events = spark.range(n).selectExpr(
        "'c' case_id", "concat('run hot.exe ', id) text", "TIMESTAMP '2024-01-01' + make_dt_interval(0,0,0,id/100000) time")
    assert presence.unmatched_in_window(probes, events, window=WINDOW).count() == 0


def test_the_bitmap_passes_all_listed_keys_and_few_others(spark):
    """What goes on to the shuffle is the hits, whatever the number of rows; a full bitmap loses none either."""
    rows = spark.range(200_000).selectExpr("concat('c', id % 3) c", "concat('name-', id) name")
    listed = spark.range(0, 200_000, 100).selectExpr("concat('c', id % 3) c", "concat('name-', id) name")
    passed = presence.perhaps_in(rows, listed, ["c", "name"])
    assert "Exchange hashpartitioning(c" not in passed._jdf.queryExecution().executedPlan().toString()
    assert 2000 <= passed.count() <= 2100
    assert passed.columns == ["c", "name"]
    full = presence.perhaps_in(rows, listed, ["c", "name"], bits=6)
    assert full.join(listed, ["c", "name"], "left_semi").count() == 2000
    # Another case's name is not in the list, a null is in none of its own either.
    odd = spark.createDataFrame([("c1", "name-0"), ("c0", "name-0"), (None, "name-0")], "c string, name string")
    assert [r.c for r in presence.perhaps_in(odd, listed, ["c", "name"]).collect()] == ["c0"]


@pytest.mark.parametrize("limit", [presence.BROADCAST_LIMIT_BYTES, 0])
def test_names_are_sought_in_their_own_case_and_long_names_whole(spark, limit):
    long = "x" * 3000 + ".exe"
    probes = [(1, "a", "one.exe", START), (2, "b", "two.exe", START), (3, "b", long, START), (4, None, "one.exe", START)]
    events = [("a", "two.exe one.ex", START), ("b", "one.exe " + "-" * 700 + long.upper(), START), (None, "one.exe", START)]
    assert _unmatched(spark, probes, events, broadcast_limit=limit) == Counter({1: 1, 2: 1, 4: 1})
    seen = presence.mentions(
        spark.createDataFrame(events, "c string, text string, time timestamp"),
        spark.createDataFrame([(case, name) for _, case, name, _ in probes], "c string, name string"),
        keep=["c"], by=["c"], broadcast_limit=limit,
    )
    found = {tuple(r) for r in seen.collect()}
    # Texts that only begin like a listed name may come out of the broadcast form; the bitmap of names drops them.
    assert ("b", long) in found and {case for case, _ in found} == {"b"}
    assert limit or found == {("b", long)}


# --- gates, failures, trees ----------------------------------------------------------------------


def test_gate_and_quarantine(spark):
    rows = spark.createDataFrame([("a", "f", 1), ("b", "g", 2)], "case_id string, source_path string, n int")
    other = spark.createDataFrame([("a",), ("a",)], "case_id string")
    assert [r.n for r in only_cases_with(rows, other).collect()] == [1]
    bad = spark.createDataFrame([("b", "g", "broken")], "case_id string, source_path string, reason string")
    assert [r.n for r in without_bad_files(rows, bad).collect()] == [1]


def test_split_failures(spark):
    df = spark.createDataFrame(
        [("c", "f", 1, None), ("c", "f", 2, "bad")], "case_id string, source_path string, record_number int, reason string"
    )
    good, bad = split_failures(df)
    assert [r.record_number for r in good.collect()] == [1]
    assert bad.columns == ["case_id", "source_path", "record_number", "reason"]
    assert [r.record_number for r in bad.collect()] == [2]


CELLS = "case_id string, source_path string, key_id bigint, parent_id bigint, name string, reason string"


def test_tree_leaves_out_failed_orphaned_and_looping_keys(spark):
    rows = [
        ("c", "h", 1, None, "ROOT", None), ("c", "h", 2, 1, "A", None), ("c", "h", 3, 2, "B", None),
        ("c", "h", 4, 1, "bad", "unreadable"), ("c", "h", 5, 4, "below bad", None), ("c", "h", 6, 5, "deeper", None),
        ("c", "h", 7, 99, "orphan", None), ("c", "h", 8, 9, "loop", None), ("c", "h", 9, 8, "loop", None),
        ("c", "other", 1, None, "R2", None), ("c", "other", 2, 1, "Z", None),
    ]
    out = key_paths(spark.createDataFrame(rows, CELLS)).collect()
    assert {(r.source_path, r.path) for r in out} == {
        ("h", "ROOT"), ("h", "ROOT\\A"), ("h", "ROOT\\A\\B"), ("other", "R2"), ("other", "R2\\Z")
    }


def test_tree_of_a_long_chain(spark):
    rows = [("c", "h", i, i - 1 if i else None, str(i), None) for i in range(2000)]
    rows += [("c", "loop", i, (i + 1) % 7, str(i), None) for i in range(7)]
    out = key_paths(spark.createDataFrame(rows, CELLS))
    assert out.count() == 2000
    assert out.filter(F.col("key_id") == 1999).first().names == [str(i) for i in range(2000)]
    order = [r.key_id for r in out.orderBy("names").limit(3).collect()]
    assert order == [0, 1, 2]


def test_unreadable_keys_are_listed(spark):
    rows = [("c", "h", 1, None, "R", None), ("c", "h", 4, 1, "bad", "unreadable")]
    assert [tuple(r) for r in key_failures(spark.createDataFrame(rows, CELLS)).collect()] == [("c", "h", 4, "unreadable")]


def test_subkey_counts(spark):
    rows = [("c", "h", 1, None, "R", None), ("c", "h", 2, 1, "A", None), ("c", "h", 3, 1, "B", None)]
    out = with_subkey_counts(spark.createDataFrame(rows, CELLS))
    assert {(r.key_id, r.subkey_count) for r in out.collect()} == {(1, 2), (2, 0), (3, 0)}
