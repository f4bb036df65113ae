"""Gradient-boosted trees for tables of numbers, and thresholds calibrated on held-out rows.

Trees only see bins. So a table of any size is first counted by the bins of its rows, and every level of a
tree is a job over these counts: all rows are learned from, and what comes back are sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BINS = 32
QUANTILES = np.linspace(0, 1, BINS)[1:-1]
CHANCES = 1 << 16


@dataclass
class Boosted:
    """Trees of fixed depth as tables: feature and cut of every inner node, value of every leaf."""

    edges: list[np.ndarray]
    depth: int
    bias: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def binned(self, rows: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(self.edges)]
        return np.stack(columns, axis=1).astype(np.int64) if columns else np.zeros((len(rows), 0), np.int64)

    def _leaves(self, binned: np.ndarray, tree) -> np.ndarray:
        feature, cut, _ = tree
        node = np.zeros(len(binned), dtype=np.int64)
        for _ in range(self.depth):
            right = binned[np.arange(len(binned)), feature[node]] > cut[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def chance(self, rows: np.ndarray) -> np.ndarray:
        """Chance of class 1 of every row, one of ``CHANCES`` + 1 values: so many can be counted over any table."""
        return self.chance_of_bins(self.binned(rows))

    def chance_of_bins(self, binned: np.ndarray) -> np.ndarray:
        odds = np.full(len(binned), self.bias)
        for tree in self.trees:
            odds += self.rate * tree[2][self._leaves(binned, tree)]
        return np.rint(CHANCES / (1 + np.exp(-odds))) / CHANCES


# A row's slope and curve as whole numbers: their sums are the same however the rows are dealt.
_UNIT = 1 << 24

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sums(model: Boosted, tree: Tree, level: int, binned: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Slopes and curves by feature, node of the level and bin, of rows that stand for so many of each class."""
    odds = np.full(len(binned), model.bias)
    for done in model.trees:
        odds += model.rate * done[2][model._leaves(binned, done)]
    chance = 1 / (1 + np.exp(-odds))
    slope = np.rint((ones * (1 - chance) - zeros * chance) * _UNIT).astype(np.int64)
    curve = np.rint((ones + zeros) * chance * (1 - chance) * _UNIT).astype(np.int64)
    feature, cut, _ = tree
    node = np.zeros(len(binned), dtype=np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
    width = 2**level
    found = np.zeros((2, binned.shape[1], width * BINS), dtype=np.int64)
    for j in range(binned.shape[1]):
        key = (node - (width - 1)) * BINS + binned[:, j]
        np.add.at(found[0, j], key, slope)
        np.add.at(found[1, j], key, curve)
    return found.reshape(2, binned.shape[1], width, BINS)


def _grown(
    edges: list[np.ndarray], total: int, positive: int, sums: Callable[[Boosted, Tree, int], np.ndarray],
    rounds: int, depth: int, rate: float, smoothing: float,
) -> Boosted:
    """Second-order boosting of the logistic loss; ``sums`` gives those of a level's nodes over all rows."""
    share = (positive + 1) / (total + 2)
    model = Boosted(edges, depth, float(np.log(share / (1 - share))), rate)
    inner = 2**depth - 1
    for _ in range(rounds):
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS, dtype=np.int64)
        value = np.zeros(2**depth)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            left_of, all_of = np.zeros((2, width)), np.zeros((2, width))
            slopes, curves = sums(model, (feature, cut, value), level) / _UNIT
            for j in range(len(edges)):
                left_g, left_h = slopes[j].cumsum(axis=1), curves[j].cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = (
                    left_g**2 / (left_h + smoothing)
                    + (all_g - left_g) ** 2 / (all_h - left_h + smoothing)
                    - all_g**2 / (all_h + smoothing)
                )
                at = gain.argmax(axis=1)
                nodes = np.arange(width)
                top = gain[nodes, at]
                if j == 0:
                    # Where nothing is gained all rows go left.
                    all_of = np.stack([all_g[:, 0], all_h[:, 0]])
                    left_of = all_of.copy()
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = at[better]
                left_of[:, better] = np.stack([left_g[nodes, at], left_h[nodes, at]])[:, better]
        ends = np.stack([left_of, all_of - left_of], axis=2).reshape(2, -1)
        value = ends[0] / (ends[1] + smoothing)
        model.trees.append((feature, cut, value))
    return model


def boost(
    rows: np.ndarray, labels: np.ndarray, *, rounds: int = 40, depth: int = 3, rate: float = 0.3,
    smoothing: float = 1.0,
) -> Boosted:
    """Trees for a small table in memory."""
    edges = [np.unique(np.quantile(rows[:, j], QUANTILES)) for j in range(rows.shape[1])]
    binned = Boosted(edges, depth, 0, rate).binned(rows)
    sums = lambda model, tree, level: _sums(model, tree, level, binned, 1 - labels, labels)
    return _grown(edges, len(labels), int(labels.sum()), sums, rounds, depth, rate, smoothing)


def patterns(rows: DataFrame, edges: list[np.ndarray], by: str = "kind") -> DataFrame:
    """``rows`` (``by``, label, train, held, features) as counts: ``train_0``, ``train_1``, ``held_0`` and
    ``held_1`` of every ``by`` and ``bins``, the bins of all features as bytes."""
    model = Boosted(edges, 0, 0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                table = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = [row.tobytes() for row in model.binned(table).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in (by, "label", "train", "held")), pa.array(bins, pa.binary())],
                    names=[by, "label", "train", "held", "bins"],
                )

    schema = f"{by} string, label int, train boolean, held boolean, bins binary"
    counts = [
        F.count_if(F.col(part) & (F.col("label") == label)).alias(f"{part}_{label}")
        for part in ("train", "held") for label in (0, 1)
    ]
    return rows.select(by, "label", "train", "held", "features").mapInArrow(run, schema).groupBy(by, "bins").agg(*counts)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([list(bins) for bins in batch.column("bins").to_pylist()], dtype=np.int64)


def boost_patterns(
    counted: DataFrame, edges: list[np.ndarray], total: int, positive: int, *, rounds: int = 40, depth: int = 3,
    rate: float = 0.3, smoothing: float = 1.0,
) -> Boosted:
    """Trees for all rows of a Spark table, given as ``patterns``: a job per level of a tree.

    Tasks return the sums of their rows, some 43 KB; no row reaches the driver.
    """
    shape = (2, len(edges))
    counted = counted.select("bins", "train_0", "train_1").filter("train_0 + train_1 > 0")

    def sums(model: Boosted, tree: Tree, level: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros((*shape, 2**level, BINS), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    zeros, ones = (batch.column(c).to_numpy() for c in ("train_0", "train_1"))
                    found += _sums(model, tree, level, _matrix(batch), zeros, ones)
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["sums"])

        every = np.zeros((*shape, 2**level, BINS), dtype=np.int64)
        for part in counted.mapInArrow(run, "sums binary").collect():
            every += np.frombuffer(part["sums"], dtype=np.int64).reshape(every.shape)
        return every

    return _grown(edges, total, positive, sums, rounds, depth, rate, smoothing)


def held_chances(counted: DataFrame, model: Boosted, by: str = "kind") -> DataFrame:
    """How many held rows of each class have a chance: (``by``, ``chance``, ``held_0``, ``held_1``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                chance = pa.array(model.chance_of_bins(_matrix(batch)), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(by), chance, batch.column("held_0"), batch.column("held_1")],
                    names=[by, "chance", "held_0", "held_1"],
                )

    schema = f"{by} string, chance double, held_0 bigint, held_1 bigint"
    rows = counted.filter("held_0 + held_1 > 0").select(by, "bins", "held_0", "held_1").mapInArrow(run, schema)
    return rows.groupBy(by, "chance").agg(F.sum("held_0").alias("held_0"), F.sum("held_1").alias("held_1"))


def threshold(
    chance: np.ndarray, labels: np.ndarray, precision: float, least: float, weights: np.ndarray | None = None
) -> float:
    """The lowest cut, not below ``least``, at and above which the share of class 1 is at least ``precision``."""
    order = np.argsort(-chance, kind="stable")
    weights = np.ones(len(order), dtype=np.int64) if weights is None else weights[order]
    right = (labels[order] * weights).cumsum() / np.maximum(weights.cumsum(), 1)
    # Rows of one chance stand or fall together.
    last = np.append(chance[order][1:] != chance[order][:-1], True) if len(order) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last)
    return max(float(chance[order][good[-1]]), least) if len(good) else 1.1
