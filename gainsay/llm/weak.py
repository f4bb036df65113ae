"""A generative model of labellers that overlap, err and depend on each other; and a linear scorer.

Every labeller votes 1, 0 or -1 (abstains). The model has classes and, given each, tables of the votes;
expectation-maximisation fits them to the counts of vote patterns, so its work does not grow with the
number of rows. Labellers that still depend on each other given the class (by their conditional mutual
information) share one joint table, and the fit is repeated: two copies of one signal then count once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

VALUES = 3
Start = Callable[[np.ndarray, list[tuple[int, ...]]], np.ndarray]


def encode(votes: np.ndarray) -> np.ndarray:
    """One number per row of votes."""
    return (votes + 1).astype(np.int64) @ (VALUES ** np.arange(votes.shape[1], dtype=np.int64))


def decode(codes: np.ndarray, labellers: int) -> np.ndarray:
    places = VALUES ** np.arange(labellers, dtype=np.int64)
    return (np.asarray(codes, dtype=np.int64)[:, None] // places) % VALUES - 1


@dataclass
class LabelModel:
    """``groups`` of labellers with one table each: the chance of a vote combination given each class."""

    prior: np.ndarray
    groups: list[tuple[int, ...]]
    tables: list[np.ndarray]

    def chances(self, votes: np.ndarray) -> np.ndarray:
        """The chance of every class for every row of votes."""
        odds = np.tile(np.log(self.prior), (len(votes), 1))
        for group, table in zip(self.groups, self.tables):
            odds += np.log(table[:, encode(votes[:, list(group)])]).T
        odds = np.exp(odds - odds.max(axis=1, keepdims=True, initial=-np.inf))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of not being of class 0."""
        return 1 - self.chances(votes)[:, 0]

    def accuracies(self) -> dict[int, float]:
        """How often each labeller is right when it votes: 0 for class 0, 1 for any other."""
        out = {}
        for group, table in zip(self.groups, self.tables):
            votes, mass = decode(np.arange(table.shape[1]), len(group)), self.prior[:, None] * table
            for place, labeller in enumerate(group):
                right = mass[0, votes[:, place] == 0].sum() + mass[1:, votes[:, place] == 1].sum()
                total = mass[:, votes[:, place] >= 0].sum()
                out[labeller] = float(right / total) if total else 0.5
        return out


def fit(
    votes: np.ndarray,
    counts: np.ndarray,
    start: Start,
    *,
    anchors: tuple[np.ndarray, np.ndarray] | None = None,
    rounds: int = 50,
    smoothing: float = 1.0,
    dependence: float = 0.02,
    largest_group: int = 4,
) -> LabelModel:
    """Fit to vote patterns with their counts.

    ``start`` makes a first guess of each pattern's chances of the classes (a column for each, class 0 first)
    from the votes and the groups of labellers: first every labeller alone, then those found to
    depend on each other together. ``anchors`` are votes of rows with known classes; they enter every
    step with those classes. Without any pattern the first guess alone counts.
    """
    labellers = votes.shape[1]
    if anchors is not None:
        votes = np.concatenate([votes, anchors[0]])
        # Known rows together weigh as much as all others: they keep the classes what they are known to be.
        weight = max(1.0, counts.sum() / max(len(anchors[0]), 1))
        counts = np.concatenate([counts, np.full(len(anchors[0]), weight)])

    def run(groups: list[tuple[int, ...]]) -> tuple[LabelModel, np.ndarray]:
        chances = start(votes, groups).astype(float)
        classes = chances.shape[1]
        fixed = np.eye(classes)[anchors[1].astype(int)] if anchors is not None else chances[:0]
        chances[len(chances) - len(fixed) :] = fixed
        seen = [encode(votes[:, list(group)]) for group in groups]
        for _ in range(rounds):
            mass = chances.T * counts
            prior = (mass.sum(axis=1) + smoothing) / (mass.sum() + classes * smoothing)
            tables = []
            for group, codes in zip(groups, seen):
                size = VALUES ** len(group)
                table = np.stack([np.bincount(codes, weights=m, minlength=size) for m in mass])
                table = table + smoothing / size
                tables.append(table / table.sum(axis=1, keepdims=True))
            model = LabelModel(prior, groups, tables)
            after = model.chances(votes)
            after[len(after) - len(fixed) :] = fixed
            if np.abs(after - chances).max(initial=0) < 1e-6:
                break
            chances = after
        return model, chances

    _, chances = run([(j,) for j in range(labellers)])
    return run(_dependent(votes, counts, chances, dependence, largest_group))[0]


def _dependent(
    votes: np.ndarray, counts: np.ndarray, chances: np.ndarray, least: float, largest: int
) -> list[tuple[int, ...]]:
    """Labellers joined where their votes tell of each other beyond the class, strongest pairs first."""
    labellers = votes.shape[1]
    mass = chances.T * counts
    total = max(mass.sum(), 1e-12)
    found = []
    for a in range(labellers):
        for b in range(a + 1, labellers):
            codes = encode(votes[:, [a, b]])
            information = 0.0
            for m in mass:
                joint = np.bincount(codes, weights=m, minlength=VALUES**2).reshape(VALUES, VALUES)
                share = joint.sum() / total
                if share > 0:
                    joint = joint / joint.sum()
                    apart = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                    some = joint > 0
                    information += share * float((joint[some] * np.log(joint[some] / apart[some])).sum())
            if information >= least:
                found.append((-information, a, b))
    group_of = {j: (j,) for j in range(labellers)}
    for _, a, b in sorted(found):
        joined = tuple(sorted({*group_of[a], *group_of[b]}))
        if len(joined) <= largest:
            for j in joined:
                group_of[j] = joined
    return sorted(set(group_of.values()))


def one_vote_each(votes: np.ndarray, groups: list[tuple[int, ...]]) -> np.ndarray:
    """A first guess of two classes: the mean of what the groups say, each by the mean of its members."""
    total, spoke = np.zeros(len(votes)), np.zeros(len(votes))
    for group in groups:
        own = votes[:, list(group)]
        number = (own >= 0).sum(axis=1)
        total += np.where(number, (own == 1).sum(axis=1) / np.maximum(number, 1), 0)
        spoke += number > 0
    return two(0.1 + 0.8 * np.where(spoke, total / np.maximum(spoke, 1), 0.5))


def two(chance: np.ndarray) -> np.ndarray:
    """The columns of two classes from the chance of class 1."""
    return np.stack([1 - chance, chance], axis=1)


def one_class_per_fault(votes: np.ndarray, groups: list[tuple[int, ...]]) -> np.ndarray:
    """A first guess of class 0 for rows that no group objects to (votes 1), and a class for each group's objection.

    Rows are bad in unlike ways: with one class for all of them, a fault that few labellers see would be put
    down to the others' errors.
    """
    said = np.stack([(votes[:, list(group)] == 1).any(axis=1) for group in groups], axis=1)
    objections = said.sum(axis=1, keepdims=True)
    faults = np.where(objections > 0, 0.9 * said / np.maximum(objections, 1), 0.1 / len(groups))
    return np.concatenate([1 - faults.sum(axis=1, keepdims=True), faults], axis=1)


@dataclass
class Linear:
    """Weights of hashed features that are there or not."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, rows: int, row_of: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Chance of class 1 for rows given as (row, feature) pairs; pairs may repeat."""
        total = np.full(rows, self.bias)
        if len(self.features) and len(features):
            place = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
            hit = self.features[place] == features
            pairs = np.unique(row_of[hit].astype(np.int64) * len(self.features) + place[hit])
            np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def train(
    rows: Sequence[np.ndarray],
    labels: np.ndarray,
    features: np.ndarray,
    *,
    decay: float = 1e-3,
    steps: int = 400,
    rate: float = 0.1,
) -> Linear:
    """Logistic regression on soft labels by full-batch Adam; ``rows`` hold the features of each row."""
    features = np.unique(features)
    lengths = [len(r) for r in rows]
    row_of = np.repeat(np.arange(len(rows)), lengths)
    flat = np.concatenate([*rows, np.zeros(0, features.dtype)]).astype(features.dtype)
    place = np.minimum(np.searchsorted(features, flat), max(len(features) - 1, 0))
    hit = features[place] == flat if len(features) else np.zeros(len(flat), dtype=bool)
    row_of, place = row_of[hit], place[hit]
    weights = np.zeros(len(features) + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    if not len(rows):
        return Linear(features, weights[:-1], 0.0)
    for step in range(1, steps + 1):
        odds = weights[-1] + np.bincount(row_of, weights=weights[place], minlength=len(rows))
        miss = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - labels) / len(rows)
        slope = np.append(np.bincount(place, weights=miss[row_of], minlength=len(features)), miss.sum())
        slope[:-1] += decay * weights[:-1] / max(len(features), 1)
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Linear(features, weights[:-1], float(weights[-1]))
