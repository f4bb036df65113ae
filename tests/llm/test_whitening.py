"""Incremental eigendecomposition against numpy on the whole matrix."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gainsay.llm import whitening
from gainsay.llm.whitening import Spectrum, updated

VECTORS = "vec_id bigint, embedding array<float>"


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(0, 2**32), st.sampled_from(["full", "ties", "low", "tiny"]))
def test_an_update_is_exact(dims, seed, kind):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(dims, dims if kind != "low" else 1))
    if kind == "ties":
        base = np.diag(rng.integers(0, 2, dims).astype(float))
    values, vectors = np.linalg.eigh(base @ base.T)
    row = rng.normal(size=dims) * (1e-9 if kind == "tiny" else 1)
    row[rng.random(dims) < 0.3] = 0
    found, turned = updated(values, vectors, row)
    whole = (vectors * values) @ vectors.T + np.outer(row, row)
    scale = max(1, np.abs(whole).max())
    assert np.abs((turned * found) @ turned.T - whole).max() < 1e-13 * scale * dims
    assert np.abs(turned.T @ turned - np.eye(dims)).max() < 1e-13 * dims
    assert (np.diff(found) >= 0).all()


def test_spectra_of_blocks_single_rows_and_merges_agree():
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, size=(300, 16)) @ rng.integers(0, 3, size=(16, 16)) + 100_000
    x[100:250] = x[7]  # one vector half of the time
    centred = x - x.mean(axis=0)
    expected = np.linalg.eigvalsh(centred.T @ centred)
    block, single, left, right = (Spectrum(16) for _ in range(4))
    block.add(x)
    for row in x:
        single.add(row[None])
    left.add(x[:40])
    right.add(x[40:])
    left.merge(right)
    for spectrum in (block, single, left):
        assert np.allclose(spectrum.values, expected, rtol=0, atol=1e-12 * expected.max())
        assert spectrum.sums == x.sum(axis=0).tolist() and spectrum.n == 300


def _check(spark, rows, used, components=8):
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit("clash"), "n": F.lit(0)}))
    got = [tuple(r[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")) for r in found.collect()]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in used])
    n, dims = x.shape
    sums = x.sum(axis=0)
    y = (n * x - sums) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == n * min(dims, components)
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(used, x)}
    signs = {}
    for vec_id, component, size, deviation, white, explained, error in got:
        k = component - 1
        assert size == n and deviation == exact[vec_id]
        assert explained == pytest.approx(e[k] / e.sum(), rel=1e-9, abs=1e-13)
        assert error <= 1e-4
        if white is None:
            assert e[k] <= 1e-11 * e.sum()
            continue
        value = dict(zip([i for i, _ in used], y @ u[:, k] / math.sqrt(e[k])))[vec_id]
        signs.setdefault(k, math.copysign(1, white * value) if abs(value) > 1e-6 else 1)
        assert white * signs[k] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_whitening_against_the_whole_matrix(spark):
    rng = np.random.default_rng(9)
    used = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(400, 24)) * np.linspace(0.2, 3, 24))]
    used += [(i, used[5][1]) for i in range(400, 700)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 22), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (904, []), (905, [1.0] * 3)]
    _check(spark, used + odd, used)


def test_few_dimensions_and_no_variance(spark):
    used = [(i, [float(i % 5), 1.0, 2.0 * (i % 5)]) for i in range(40)]
    _check(spark, used, used)
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], VECTORS)).collect()
    assert len(same) == 6
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], VECTORS)).collect() == []


def test_many_parts_are_combined_in_rounds(spark):
    rng = np.random.default_rng(2)
    used = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(300, 5)))]
    frame = spark.createDataFrame(used, VECTORS).repartition(100)
    model, rows = whitening.fit(whitening.whole_vectors(frame))
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in used])
    assert model.n == 300 and model.sums == x.sum(axis=0).tolist() and rows.count() == 300
    cov = np.cov(x.T, bias=True)
    assert np.allclose(cov @ model.components, model.components * model.variances, atol=1e-9 * np.abs(cov).max())


def test_numbers_beyond_64_bits_stay_exact(spark):
    used = [(i, [float(np.float32(2.0**38 * (i % 3))), float(i)]) for i in range(200)]
    found = whitening.whiten(spark.createDataFrame(used, VECTORS)).filter("component = 1").collect()
    x = [[math.floor(1024 * Fraction(c)) + 100_000 for c in v] for _, v in used]
    sums = [sum(column) for column in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in found} == {
        i: sum((200 * a - s) ** 2 for a, s in zip(row, sums)) for (i, _), row in zip(used, x)
    }
