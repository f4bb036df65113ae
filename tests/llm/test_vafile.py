"""Exact top-k against brute force."""

import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from gainsay.llm import vafile


def _expected(rows, wanted, k):
    whole = [
        (i, [floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)
    ]
    out = []
    for at, (q, asked) in enumerate(whole):
        if wanted(q):
            scores = sorted((-sum(a * b for a, b in zip(asked, v)), i) for n, (i, v) in enumerate(whole) if n != at)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def _found(spark, rows, wanted, k, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    vectors = vafile.whole_vectors(df)
    found = vafile.top_k(vectors, vectors.filter(wanted), k, **options).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "query_rows": 7}, {"bits": 3}])
def test_random_vectors(spark, options):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-64, 64) / 64 for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, list(rows[i % 20][1])) for i in range(60)]  # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0])]
    rows += [(500, []), (501, [0.5]), (20, [9.0] * 8), (20, [9.0] * 8)]  # short ones, repeated ids and rows
    rows += [(20 + i % 2, [0.5] * 8) for i in range(40)]  # more copies than results
    assert _found(spark, rows, "vec_id % 20 = 0", 5, **options) == _expected(rows, lambda q: q % 20 == 0, 5)


def test_few_and_no_rows(spark):
    rows = [(50, [1.0, 2.0]), (51, [3.0, -1.0])]
    assert _found(spark, rows, "vec_id % 50 = 0", 5) == _expected(rows, lambda q: q == 50, 5)
    assert _found(spark, [(50, [1.0])], "vec_id % 50 = 0", 5) == []
    assert _found(spark, [], "vec_id % 50 = 0", 5) == []


def test_large_numbers_stay_exact(spark):
    rows = [(0, [1.0e7, 1.0]), (1, [1.0e7, 1.0]), (2, [1.0e7, -1.0]), (3, [-1.0e7, 5.0])]
    assert _found(spark, rows, "vec_id = 0", 2) == _expected(rows, lambda q: q == 0, 2)


def test_most_vectors_are_not_read(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1 + 5 * (i % 50 == 0)) for _ in range(6)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = vafile.whole_vectors(df)
    found = vafile.top_k(vectors, vectors.filter("vec_id < 10"), 3).agg(F.avg("exact_reads")).first()[0]
    assert found < 600


def test_bounds_hold_at_any_size():
    rng = random.Random(3)
    held = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    for size in (3, 200, 1 << 40, 1 << 62):
        rows = [[rng.randint(-size, size) for _ in range(9)] for _ in range(60)]
        found, shifts = vafile.cells([np.array(r) for r in rows], 5)
        cell = np.array([np.frombuffer(c, dtype=np.int8) for c in found]).astype(np.int64)
        lower, upper = vafile.bounds(np.array(rows[:20]), cell, np.array(shifts))
        for i, q in enumerate(rows[:20]):
            for j, v in enumerate(rows):
                assert lower[i, j] <= held(sum(a * b for a, b in zip(q, v))) <= upper[i, j]


def test_a_hot_group_of_copies_is_not_read(spark):
    rows = [(i, [1.0, 1.0]) for i in range(2000)] + [(5000 + i, [i / 1000, 0.1]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    vectors = vafile.whole_vectors(df)
    found = vafile.top_k(vectors, vectors.filter("vec_id % 500 = 0"), 3)
    assert found.agg(F.max("exact_reads")).first()[0] < 300
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert rows == _expected([(i, v) for i, v in df.collect()], lambda q: q % 500 == 0, 3)
