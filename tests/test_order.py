"""Positions, sessions and nearest rows against plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from gainsay.operators.order import PART, in_parts, in_sessions, nearest, numbered
from gainsay.plans.timeline import nearest_events, timeline
from gainsay.sources.case import CaseTables

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SPAN = "key string, at timestamp, id long"


def _at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def _rows(rng, number, keys=("a", "b", "c", None), ids=10**6):
    """Half of all rows have one key, and many one time."""
    return [
        (rng.choice([keys[0], rng.choice(keys)]), rng.choice([None, 0, 0, rng.randrange(50), rng.randrange(5000)]), rng.randrange(ids))
        for _ in range(number)
    ]


def _frame(spark, rows, schema=SPAN):
    return spark.createDataFrame([(k, _at(t), i) for k, t, i in rows], schema).repartition(7)


def test_positions_with_nulls_ties_and_directions(spark):
    rng = random.Random(1)
    rows = _rows(rng, 500, ids=5)
    found = numbered(_frame(spark, rows), [F.col("key").desc(), "at", "id"]).collect()
    none = datetime.min.replace(tzinfo=timezone.utc)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    expected = [r for k in ("c", "b", "a", None) for r in sorted((r for r in rows if r[0] == k), key=order)]
    assert sorted(r.position for r in found) == list(range(1, 501))
    by_place = sorted(found, key=lambda r: r.position)
    assert [(r.key, r.at and r.at.astimezone(timezone.utc) or none, r.id) for r in by_place] == [
        (k, _at(t) or none, i) for k, t, i in expected
    ]
    assert numbered(_frame(spark, []), ["id"]).collect() == []


def test_equal_rows_are_spread_over_parts(spark):
    rows = spark.range(0, 40_000, 1, 8).select(F.lit("hot").alias("key"), F.lit(1).alias("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = in_parts(rows, ["key", "id"]).groupBy(PART).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 20_000
    assert [r.position for r in numbered(rows, ["key"]).orderBy("position").collect()] == list(range(1, 40_001))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions(spark, seed):
    rng = random.Random(seed)
    rows = _rows(rng, rng.choice([1, 30, 400]))
    found = in_sessions(_frame(spark, rows), by=["key"], time="at", idle=timedelta(seconds=60), then=["id"])
    expected, session, last = [], 0, None
    for place, (k, t, i) in enumerate(sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] or "", r[1], r[2])), 1):
        session += last is None or last[0] != k or t - last[1] > 60
        last = (k, t)
        expected.append((k, i, place, session))
    got = sorted(((r.key, r.id, r.position, r.session) for r in found.collect()), key=lambda r: r[2])
    assert got == expected


def _nearest(left, right, before=True, after=True, within=None):
    out = []
    for k, t, i in left:
        best = None
        for key, at, other in right:
            if k is None or key != k or t is None or at is None:
                continue
            apart = at - t
            if (apart < 0 and not before) or (apart > 0 and not after) or (within is not None and abs(apart) > within):
                continue
            best = min(best or (10**9, 0, 0), (abs(apart), apart, other))
        out.append((k, t, i, best and (best[1] * 10**6, best[2])))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "options"), [
    (1, {}), (2, {"after": False}), (3, {"before": False}), (4, {"within": timedelta(seconds=20)}),
    (5, {"after": False, "within": timedelta(0)}),
])
def test_nearest_against_all_pairs(spark, seed, options):
    rng = random.Random(seed)
    left, right = _rows(rng, 200), _rows(rng, rng.choice([5, 150]), keys=("a", "b", None, "z"))
    frame = _frame(spark, left).withColumns({"_part": F.lit(1), "take": F.lit("clash")})
    found = nearest(
        frame, _frame(spark, right, "key string, seen timestamp, other long"), by=["key"], left_time="at", right_time="seen",
        take=["other"], **options,
    )
    assert found.columns == ["key", "at", "id", "_part", "take", "nearest"]
    seconds = lambda at: at and int((at.astimezone(timezone.utc) - START).total_seconds())
    got = [(r.key, seconds(r.at), r.id, r.nearest and (r.nearest.micros, r.nearest.other)) for r in found.collect()]
    within = options.get("within")
    expected = _nearest(left, right, options.get("before", True), options.get("after", True), within and within.total_seconds() if within is not None else None)
    assert sorted(got, key=repr) == expected


def test_carried_over_parts_without_right_rows(spark):
    left = [("a", t, t) for t in range(1, 3000)]
    for right, at in (([("a", 0, 7)], 0), ([("a", 5000, 8)], 5000)):
        found = nearest(
            _frame(spark, left), _frame(spark, right, "key string, seen timestamp, other long"),
            by=["key"], left_time="at", right_time="seen", take=["other"],
        ).collect()
        assert len(found) == 2999
        assert all(r.nearest.other == right[0][2] and r.nearest.micros == (at - r.id) * 10**6 for r in found)


def test_no_window_spans_all_rows(spark, capsys):
    rows = _frame(spark, _rows(random.Random(1), 50))
    in_sessions(rows, by=["key"], time="at", idle=timedelta(1)).explain("formatted")
    plan = capsys.readouterr().out
    windows = [line for line in plan.splitlines() if line.startswith("Arguments:") and "windowspecdefinition" in line]
    data = [line for line in windows if "_entry" in line or "_inside" in line]
    assert data and all(f"{PART}#" in line for line in data)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_timeline_and_nearest_events_of_cases(spark):
    events = spark.createDataFrame(
        [("c", "log", 1, _at(0)), ("c", "log", 2, None), ("d", "log", 3, _at(5))],
        "case_id string, source_path string, record_number long, timestamp timestamp",
    ).withColumns({"provider_name": F.lit("p"), "raw_xml": F.lit("<x/>")})
    runs = spark.createDataFrame([("c", "pf", "X.EXE", [_at(10), None])], "case_id string, source_path string, executable_name string, last_run_times array<timestamp>")
    times = F.struct(F.lit(_at(8)).alias("creation_time"), *[F.lit(None).cast("timestamp").alias(t) for t in ("modification_time", "mft_modification_time", "access_time")])
    files = spark.createDataFrame([("c", "mft", 9), ("e", "mft", 10)], "case_id string, source_path string, record_number long").withColumns(
        {"standard_information": times, "filename": F.lit("f")}
    )
    tables = CaseTables.build(spark, events=events, prefetch=runs, mft=files)
    found = timeline(tables, idle=timedelta(seconds=5)).orderBy("position").collect()
    assert [(r.case_id, r.kind, r.number, r.session) for r in found] == [
        ("c", "event", 1, 1), ("c", "file creation_time", 9, 2), ("c", "run", 0, 2), ("d", "event", 3, 3), ("e", "file creation_time", 10, 4)
    ]
    near = {r.case_id: r.nearest for r in nearest_events(tables).collect()}
    assert near["e"] is None and (near["c"].event_number, near["c"].micros) == (1, -8_000_000)
    empty = CaseTables.build(spark)
    assert timeline(empty).collect() == [] and nearest_events(empty).collect() == []


def test_parts_are_as_many_as_the_rows_need(spark, monkeypatch):
    """With small parts: more parts than the session's partitions, places and windows as before."""
    from gainsay.operators import order

    monkeypatch.setattr(order, "PART_ROWS", 50)
    rows = spark.range(2000).selectExpr("'k' case_id", "timestamp_seconds(id * 7 % 2000) at", "id")
    assert order.in_parts(rows, ["at"]).agg(F.max("_part")).first()[0] > 30
    found = order.in_sessions(rows, by=["case_id"], time="at", idle=timedelta(seconds=0)).collect()
    assert sorted((r.id * 7 % 2000 + 1, r.id * 7 % 2000 + 1) for r in found) == sorted((r.position, r.session) for r in found)
    both = order.nearest(rows, rows.filter("id % 100 = 0"), by=["case_id"], left_time="at", right_time="at", take=["id"], after=False)
    for r in both.collect():
        at = r.id * 7 % 2000
        assert r.nearest.id * 7 % 2000 == at // 100 * 100
    plan = order.sorted_in_parts(rows, ["at"])
    assert plan.rdd.getNumPartitions() >= 30
    assert [r.at for r in plan.collect()] == sorted(r.at for r in rows.collect())
