"""Whitening of embeddings by an incremental eigendecomposition.

A partition holds the spectrum of what it has read: number, exact sums, mean, and the eigenvalues and
eigenvectors of the scatter about the mean. A vector changes the scatter by a centred rank-one term,
whose new eigenvalues are the roots of a secular equation between the old ones; parts that the term does
not touch, or that coincide, are deflated. Blocks of more rows than dimensions are first turned by an
orthogonal factor to as many rows as dimensions with the same scatter, which saves updates, not accuracy.
Spectra of partitions are combined, 32 at a time and in rounds, by the same rank-one updates: one per
eigenvector of the smaller side and one for the distance of the means.

The combined basis is then refined by Rayleigh and Ritz: a pass projects all rows on it and adds up
their small matrix, whose eigenvectors turn the basis into components exact to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gainsay.llm.common import begin, staged

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
FAN_IN = 32
BLOCK_ROWS = 4096
# Components with a smaller share of all variance cannot be told from rounding.
LEAST_SHARE = 1e-12

_LARGEST = float(1 << 52)
_SAFE = 1 << 62
_EPS = np.finfo(float).eps
_STEPS = 100

_SPECTRUM = "id bigint, dims int, n bigint, sums string, mean binary, values binary, vectors binary"
_PART = "id bigint, dims int, n bigint, mean binary, scatter binary"
_WHITE = "vec_id bigint, component int, deviation decimal(38,0), whitened double"


class Model(NamedTuple):
    """What the fit list gives: its size and exact sums, components as columns, their variances, all variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def usable(self) -> np.ndarray:
        return self.variances > LEAST_SHARE * self.trace


def whole_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``: each entry as floor(1024 * c) + 100000. Rows with a null or non-finite entry go.

    So do entries from 2**42 up, whose numbers would leave the range of exact doubles.
    """
    c = F.col(embedding)
    inside = lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(_LARGEST / SCALE), F.lit(False))
    return vectors.filter(c.isNotNull() & F.forall(c, inside)).select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("bigint") + SHIFT).alias("x"),
    )


# --- rank-one updates ---------------------------------------------------------------------------


def updated(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of a symmetric matrix plus ``row`` times itself."""
    z = vectors.T @ row
    size = float(np.sqrt(z @ z))
    if size == 0.0:
        return values, vectors
    small = 8 * _EPS * max(abs(values[0]), abs(values[-1]), size * size)
    # Parts too small to be told from rounding are left alone.
    z = np.where(np.abs(z) * size > small, z, 0.0)
    values, z, vectors = _merged_ties(values, z, vectors, small)
    live = np.flatnonzero(z)
    if not len(live):
        return values, vectors
    found, turn = _secular(values[live], z[live])
    values, vectors = values.copy(), vectors.copy()
    values[live] = found
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _merged_ties(
    values: np.ndarray, z: np.ndarray, vectors: np.ndarray, small: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turn pairs of eigenvectors with nearly equal values so that one of them is left alone by the update."""
    live = np.flatnonzero(z)
    gap, squares, product = np.diff(values[live]), z[live] ** 2, np.abs(z[live][1:] * z[live][:-1])
    if not (gap * product <= small * (squares[1:] + squares[:-1])).any():
        return values, z, vectors
    values, z, vectors = values.copy(), z.copy(), vectors.copy()
    last = live[0]
    for i in live[1:].tolist():
        long = float(np.hypot(z[last], z[i]))
        if (values[i] - values[last]) * abs(z[last] * z[i]) <= small * long * long:
            c, s = z[i] / long, z[last] / long
            vectors[:, [last, i]] = vectors[:, [last, i]] @ np.array([[c, s], [-s, c]])
            values[[last, i]] = np.array([[c * c, s * s], [s * s, c * c]]) @ values[[last, i]]
            z[last], z[i] = 0.0, long
        last = i
    return values, z, vectors


def _secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z**2 / (d - x)), one above each of the rising ``d``, and the eigenvectors that they give.

    A root is held as its distance from the nearer pole, so that differences with all poles are exact.
    """
    k, w = len(d), z * z
    above = np.append(d[1:], d[-1] + w.sum())
    half = (above - d) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (w / ((d - d[:, None]) - half[:, None])).sum(axis=1)
        left = middle >= 0
        left[-1] = True
        origin = np.where(left, d, above)
        poles = d - origin[:, None]
        low = np.where(left, 0.0, -half)
        high = np.where(left, half, 0.0)
        high[-1] = above[-1] - d[-1]
        a, b = d - origin, above - origin
        below = np.tri(k, dtype=bool)
        t = (low + high) / 2
        for _ in range(_STEPS):
            away = poles - t[:, None]
            terms = w / away
            slopes = terms / away
            f = 1 + terms.sum(axis=1)
            # No root can be told from t where f is lost in the rounding of its own terms.
            done = np.abs(f) <= 4 * _EPS * (1 + np.abs(terms).sum(axis=1))
            if done.all():
                break
            low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
            s = np.where(below, slopes, 0).sum(axis=1) * (a - t) ** 2
            r = np.where(below, 0, slopes).sum(axis=1) * (b - t) ** 2
            c = f - s / (a - t) - np.where(r > 0, r / (b - t), 0)
            # The root of c + s / (a - t) + r / (b - t) between the two poles.
            p = c * (a + b) + s + r
            q = c * a * b + s * b + r * a
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            far = p + np.where(p >= 0, root, -root)
            one, two = 2 * q / far, far / (2 * c)
            new = np.where((one > low) & (one < high), one, two)
            new[-1] = a[-1] + s[-1] / c[-1]
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            new = np.where(done, t, new)
            step, t = np.abs(new - t), new
            if (step <= 2 * _EPS * np.abs(t)).all():
                break
    apart = t[:, None] - poles
    # The vector for which these roots are exact: eigenvectors from it are orthogonal to working precision.
    under = d[:, None] - d[None, :]
    beside = np.vstack([d[1:, None] - d[None, :], np.ones((1, k))])
    ratio = apart / np.where(np.tri(k, k, -1, dtype=bool).T, under, beside)
    fitted = np.sqrt(np.maximum(ratio.prod(axis=0), 0)) * np.sign(z)
    turn = -(fitted / apart).T
    return origin + t, turn / np.linalg.norm(turn, axis=0)


class Spectrum:
    """Number, exact sums, mean, and eigenvalues and eigenvectors of the scatter of some rows."""

    def __init__(self, dims: int):
        self.n, self.sums = 0, [0] * dims
        self.mean, self.values, self.vectors = np.zeros(dims), np.zeros(dims), np.eye(dims)

    def add(self, x: np.ndarray) -> None:
        """Rows of whole numbers."""
        sums = [int(s) for s in _wide(x, len(x)).sum(axis=0)]
        mean = np.array([s / len(x) for s in sums])
        rows = x - mean
        if len(rows) > len(self.mean):
            rows = np.linalg.qr(rows, mode="r")
        self._absorb(len(x), sums, mean, rows)

    def merge(self, other: Spectrum) -> None:
        if other.n > self.n:
            self.__dict__, other.__dict__ = other.__dict__, self.__dict__
        rows = np.sqrt(np.maximum(other.values, 0))[:, None] * other.vectors.T
        self._absorb(other.n, other.sums, other.mean, rows[other.values > 0])

    def _absorb(self, n: int, sums: list[int], mean: np.ndarray, rows: np.ndarray) -> None:
        if n == 0:
            return
        total = self.n + n
        apart = (mean - self.mean) * np.sqrt(self.n / total * n)
        for row in (*rows, apart):
            self.values, self.vectors = updated(self.values, self.vectors, row)
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        self.n, self.mean = total, np.array([s / total for s in self.sums])

    def stored(self, place: int) -> dict:
        return {
            "id": place, "dims": len(self.mean), "n": self.n, "sums": ",".join(map(str, self.sums)),
            "mean": self.mean.tobytes(), "values": self.values.tobytes(), "vectors": self.vectors.tobytes(),
        }

    @classmethod
    def read(cls, row) -> Spectrum:
        spectrum = cls(row["dims"])
        spectrum.n, spectrum.sums = row["n"], [int(s) for s in row["sums"].split(",")]
        spectrum.mean, spectrum.values = (np.frombuffer(row[c], dtype=float) for c in ("mean", "values"))
        spectrum.vectors = np.frombuffer(row["vectors"], dtype=float).reshape(row["dims"], -1)
        return spectrum


def _wide(x: np.ndarray, factor: int) -> np.ndarray:
    """``x`` in 64 bits where ``factor`` times any of it fits, else in Python's integers."""
    largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x if largest * factor < _SAFE else x.astype(object)


# --- passes over the rows ------------------------------------------------------------------------


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and matrices of the rows, by length; empty vectors have no place."""
    column = batch.column("x")
    ends = np.asarray(column.offsets)
    sizes, flat = np.diff(ends), np.asarray(column.values)
    for dims in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dims)
        for at in range(0, len(rows), BLOCK_ROWS):
            some = rows[at : at + BLOCK_ROWS]
            yield some, flat[ends[some][:, None] + np.arange(dims)]


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("whitening")
    held: dict[int, Spectrum] = {}
    for batch in batches:
        for _, x in _blocks(batch):
            held.setdefault(x.shape[1], Spectrum(x.shape[1])).add(x)
    if held:
        yield pa.RecordBatch.from_pylist([s.stored(_partition()) for s in held.values()], _arrow(_SPECTRUM))


def _arrow(ddl: str) -> pa.Schema:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
             "decimal(38,0)": pa.decimal128(38, 0)}
    return pa.schema([(f.split()[0], types[f.split()[1]]) for f in ddl.split(", ")])


def _combined(parts: DataFrame, schema: str, merge: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row per length of vectors: rounds that merge ``FAN_IN`` rows each, so no task gets many."""
    parts = staged(parts, "whitening")
    last = parts.agg(F.max("id")).first()[0] or 0
    while last > 0:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([{**merge(rows), "id": int(rows["id"].iloc[0])}])

        step = F.floor(F.col("id") / FAN_IN).cast("bigint")
        parts = parts.withColumn("id", step).groupBy("dims", "id").applyInPandas(run, schema)
        last //= FAN_IN
    return parts


def _merged_spectra(rows: pd.DataFrame) -> dict:
    whole = Spectrum(int(rows["dims"].iloc[0]))
    for row in rows.to_dict("records"):
        whole.merge(Spectrum.read(row))
    return whole.stored(0)


def _merged_scatters(rows: pd.DataFrame) -> dict:
    """Number, mean and centred scatter of several parts (sums of squares never meet a far-off mean)."""
    n, mean, scatter = 0, 0.0, 0.0
    for row in rows.to_dict("records"):
        n, mean, scatter = _joined(
            (n, mean, scatter), row["n"], np.frombuffer(row["mean"], dtype=float), np.frombuffer(row["scatter"], dtype=float)
        )
    return {"dims": rows["dims"].iloc[0], "n": n, "mean": mean.tobytes(), "scatter": scatter.tobytes()}


def _joined(held: tuple, n: int, mean: np.ndarray, scatter: np.ndarray) -> tuple:
    apart = mean - held[1]
    total = held[0] + n
    between = np.outer(apart, apart).reshape(scatter.shape) * (held[0] / total * n)
    return total, held[1] + apart * (n / total), held[2] + scatter + between


def _scatter(rows: DataFrame, dims: int, project: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """Number and centred scatter of all projected rows, added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("whitening")
        held = None
        for batch in batches:
            for _, x in _blocks(batch):
                y = project(x)
                mean = y.mean(axis=0)
                part = (len(y), mean, (y - mean).T @ (y - mean))
                held = part if held is None else _joined(held, *part)
        if held is not None:
            yield pa.RecordBatch.from_pylist(
                [{"id": _partition(), "dims": dims, "n": held[0], "mean": held[1].tobytes(), "scatter": held[2].tobytes()}],
                _arrow(_PART),
            )

    found = _combined(rows.select("x").mapInArrow(run, _PART), _PART, _merged_scatters).first()
    whole = np.frombuffer(found["scatter"], dtype=float)
    side = int(round(len(whole) ** 0.5))
    return found["n"], whole.reshape(side, side)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    exact = _wide(x, n)
    if exact.dtype != object and max(map(abs, sums)) < _SAFE:
        return n * exact - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _offsets(x, n, sums).astype(float) / n


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Model | None, DataFrame]:
    """The model of ``rows`` (see ``whole_vectors``) and the rows it holds for.

    Vectors of another length than most rows have (of equal numbers: than the longest) take no part.
    None where no row has a vector of any length.
    """
    spectra = _combined(rows.select("x").mapInArrow(_spectra, _SPECTRUM), _SPECTRUM, _merged_spectra)
    row = spectra.orderBy(F.desc("n"), F.desc("dims")).first()
    if row is None:
        return None, rows.filter(F.lit(False))
    spectrum = Spectrum.read(row.asDict())
    n, sums, dims = spectrum.n, spectrum.sums, len(spectrum.mean)
    rows = rows.filter(F.size("x") == dims)
    basis = np.linalg.qr(spectrum.vectors)[0]
    _, ritz = _scatter(rows, dims, lambda x: _centred(x, n, sums) @ basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    chosen = basis @ turn[:, order]
    # Either sign would do; the largest entry is positive.
    sign = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return Model(n, sums, chosen * sign, np.maximum(values[order], 0) / n, float(np.trace(ritz)) / n), rows


def whitened(model: Model, x: np.ndarray) -> np.ndarray:
    """Rows on the components over their standard deviations; NaN on components without variance."""
    scale = np.where(model.usable, np.sqrt(model.variances), np.nan)
    return _centred(x, model.n, model.sums) @ model.components / scale


def identity_error(model: Model, rows: DataFrame) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity; None without a usable component."""
    usable = np.flatnonzero(model.usable)
    if not len(usable):
        return None
    n, scatter = _scatter(rows, len(usable), lambda x: whitened(model, x)[:, usable])
    return float(np.abs(scatter / n - np.eye(len(usable))).max())


def transform(model: Model, rows: DataFrame) -> DataFrame:
    """``vec_id``, ``component`` (from 1), ``deviation`` and ``whitened`` of every row."""
    count = model.components.shape[1]

    def deviation(x: np.ndarray) -> list[int]:
        apart = _offsets(x, model.n, model.sums)
        largest = max(abs(int(apart.min())), abs(int(apart.max())))
        if apart.dtype != object and largest * largest * apart.shape[1] >= _SAFE:
            apart = apart.astype(object)
        return (apart * apart).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("whitening")
        from decimal import Decimal

        for batch in batches:
            for places, x in _blocks(batch):
                white = whitened(model, x)
                exact = pa.array([Decimal(v) for v in deviation(x)], pa.decimal128(38, 0))
                yield pa.record_batch([
                    batch.column("vec_id").take(pa.array(np.repeat(places, count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    exact.take(pa.array(np.repeat(np.arange(len(x)), count))),
                    pa.array(white.reshape(-1), from_pandas=True),
                ], schema=_arrow(_WHITE))

    return rows.select("vec_id", "x").mapInArrow(run, _WHITE)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: n, deviation, whitened, explained and the one identity error.

    Rows whose vector is null, empty, of another length than most, or holds a null or non-finite entry
    take no part (see ``whole_vectors``, ``fit``). A null ``vec_id`` and repeated rows are rows like others.
    Vectors of fewer dimensions than components have as many components as dimensions. A component
    with less than 1e-12 of all variance has a null ``whitened`` and no part in the identity error; without any
    variance ``explained`` is null too. Equal eigenvalues keep the order in which they are found. An empty
    table gives no rows. Columns other than vec_id and embedding are not read.
    """
    model, rows = fit(whole_vectors(vectors), components)
    if model is None:
        empty = rows.sparkSession.createDataFrame([], _WHITE)
        return empty.withColumns({
            "n": F.lit(0).cast("bigint"), "explained": F.lit(None).cast("double"), "identity_error": F.lit(None).cast("double"),
        })
    shares = (model.variances / model.trace).tolist() if model.trace > 0 else [None] * len(model.variances)
    explained = F.array(*[F.lit(s).cast("double") for s in shares])
    return transform(model, rows).withColumns({
        "n": F.lit(model.n).cast("bigint"),
        "explained": F.element_at(explained, F.col("component")),
        "identity_error": F.lit(identity_error(model, rows)).cast("double"),
    })
