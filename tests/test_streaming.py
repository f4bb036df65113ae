"""Live rules against the batch ones: late, repeated and unordered rows, restarts in between."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from gainsay.operators.gaps import between_islands, record_gaps
from gainsay.operators.presence import unmatched_in_window
from gainsay.streaming import numbers
from gainsay.streaming.numbers import current_gaps, island_changes, merged
from gainsay.streaming.presence import live_unmatched
from gainsay.workload.live import replayed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
RECORDS = "log string, n long"


def test_merged_islands_of_random_numbers():
    rng = random.Random(1)
    for _ in range(500):
        first = last = np.zeros(0, dtype=np.int64)
        seen = set()
        for _ in range(4):
            numbers = {rng.randrange(-20, 40) for _ in range(rng.randrange(1, 12))}
            seen |= numbers
            first, last = merged(first, last, np.array(sorted(numbers)))
            assert {n for a, b in zip(first, last) for n in range(a, b + 1)} == seen
            assert (first[1:] > last[:-1] + 1).all()


def test_between_islands_over_many_parts(spark):
    rng = random.Random(2)
    rows, expected = [], []
    for key in ("a", "b", None):
        at = 0
        for i in range(400):
            start = at + rng.choice([1, 2, 50])
            if i and start > at + 1:
                expected.append((key, at, start, start - at - 1))
            at = start + rng.randrange(5)
            rows.append((key, start, at))
    found = between_islands(spark.createDataFrame(rows, "key string, first long, last long").repartition(5), by=["key"])
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_replayed_numbers_give_the_gaps_of_the_batch(spark):
    rng = random.Random(3)
    numbers = [("hot", n) for n in rng.sample(range(-70_000, 140_000), 600)] + [(k, n) for k in "abc" for n in rng.sample(range(90), 40)]
    rng.shuffle(numbers)
    numbers += rng.sample(numbers, 50) + [("a", None)]
    arrivals = [{"records": spark.createDataFrame(numbers[at : at + 400], RECORDS)} for at in range(0, len(numbers), 400)]
    changes = replayed(spark, arrivals, lambda inputs: island_changes(inputs["records"], by=["log"], number="n"))
    found = current_gaps(changes, by=["log"])
    expected = record_gaps(spark.createDataFrame(numbers, RECORDS), by=["log"], number="n")
    assert sorted(map(tuple, found.select("log", "previous", "current", "missing").collect())) == sorted(
        map(tuple, expected.select("log", "previous", "current", "missing").collect())
    )


def test_a_call_has_many_sources(spark):
    """Many small logs are few states; names and numbers come back as they are, nulls too."""
    names = [(None if i == 0 else f'é"{i}\\', None if i == 1 else 2**62 + i) for i in range(3000)]
    rows = [(*name, n) for i, name in enumerate(names) for n in (i - 5, i - 4, i + 3, 2**40 + i, -(2**40) - i)]
    schema = "log string, disk long, n long"
    arrivals = [{"records": spark.createDataFrame(rows[at::2], schema)} for at in range(2)]
    calls = spark.sparkContext.accumulator(0)

    class Counted(numbers.Islands):
        def handleInputRows(self, *arguments):
            calls.add(1)
            return super().handleInputRows(*arguments)

    plain, numbers.Islands = numbers.Islands, Counted
    try:
        changes = replayed(spark, arrivals, lambda inputs: island_changes(inputs["records"], by=["log", "disk"], number="n", groups=4))
    finally:
        numbers.Islands = plain
    # Two arrivals, four groups, four ranges: -1, 0 and one on either side far away.
    assert 0 < calls.value <= 2 * 4 * 5
    found = current_gaps(changes, by=["log", "disk"])
    expected = record_gaps(spark.createDataFrame(rows, schema), by=["log", "disk"], number="n")
    columns = ["log", "disk", "previous", "current", "missing"]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, expected.select(columns).collect()), key=repr)


@pytest.mark.parametrize("minutes", [0, 5])
def test_replayed_runs_give_those_of_the_batch(spark, minutes):
    rng = random.Random(minutes)
    at = lambda: START + timedelta(minutes=rng.randrange(600))
    names = ["A.EXE", "b.exe", "C.exe"]
    runs = [(rng.choice("xy"), rng.choice(names), at(), i) for i in range(60)]
    events = [(rng.choice("xy"), f"started {rng.choice(names).lower()} ok", at()) for _ in range(60)] + [("x", None, at()), ("y", "", START)]
    runs_of = lambda rows: spark.createDataFrame(rows, "case_id string, name string, time timestamp, id long")
    events_of = lambda rows: spark.createDataFrame(rows, "case_id string, text string, time timestamp")
    cuts = [START + timedelta(minutes=m) for m in (0, 200, 400, 601)]
    inside = lambda rows, i: [r for r in rows if cuts[i] <= r[2] < cuts[i + 1]]
    arrivals = [{"runs": runs_of(inside(runs, i)), "events": events_of(inside(events, i))} for i in range(3)]
    tick = START + timedelta(days=2)
    arrivals.append({"runs": runs_of([("t", "A.EXE", tick, -1)]), "events": events_of([("t", "t", tick)])})
    watched = spark.createDataFrame([(n,) for n in names], "name string")
    window = timedelta(minutes=minutes)
    found = replayed(spark, arrivals, lambda inputs: live_unmatched(inputs["runs"], inputs["events"], watched, window=window, late=timedelta(minutes=1)))
    expected = unmatched_in_window(runs_of(runs), events_of(events), window=window)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in expected.collect())
    assert found.columns == ["case_id", "name", "time", "id"]


def test_a_burst_is_held_as_one_row_per_bucket(spark, tmp_path):
    events = [("x", "started a.exe", START + timedelta(milliseconds=i)) for i in range(500)]
    spark.createDataFrame(events, "case_id string, text string, time timestamp").write.parquet(str(tmp_path / "events"))
    spark.createDataFrame([("x", "A.EXE", START, 1)], "case_id string, name string, time timestamp, id long").write.parquet(str(tmp_path / "runs"))
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    found = live_unmatched(
        read("runs"), read("events"), spark.createDataFrame([("A.exe",)], "name string"),
        window=timedelta(minutes=5), late=timedelta(minutes=1),
    )
    running = (
        found.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in running.recentProgress) < 10
