"""Text quality by weak labels.

Heuristic labellers look at the form of a text (repetition, capitals, symbols, lengths, ...) and vote good,
bad, or nothing. Their vote patterns are counted over the whole corpus; expectation-maximisation finds
from the counts alone how accurate each labeller is and which say the same thing, with a class for good
texts and one for every kind of fault. The posterior labels
of a bounded sample train a linear scorer over hashed features (measures in steps, shapes of words and
their shares), which scores every document. No human labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gainsay.llm.common import begin, raw, slices, texts, thinned
from gainsay.llm.shingles import mix, word_hashes
from gainsay.llm.weak import LabelModel, Linear, decode, encode, fit, one_class_per_fault, train

SAMPLE = 10_000
CUT = 0.5

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_COMMON_MARKS = np.zeros(256, dtype=bool)
_COMMON_MARKS[list(b".,;:'\"-?!()")] = True
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _COMMON_MARKS)

# A labeller says bad at or beyond the first number and good up to the second; the other way
# round where the first is smaller. Between them it abstains. Capitals are those inside words; the most
# frequent word counts without its first occurrence, so short texts are not repetitive by being short.
LABELLERS = {
    "repeated_neighbours": (0.08, 0.02),
    "most_frequent_word": (0.25, 0.12),
    "distinct_words": (0.15, 0.35),
    "capitals": (0.30, 0.10),
    "symbols": (0.04, 0.01),
    "doubled_symbols": (0.015, 0.003),
    "exclamations": (0.10, 0.02),
    "bars": (0.08, 0.01),
    "letters": (0.80, 0.90),
    "repeated_lines": (0.30, 0.10),
    "words": (0.5, 8.0),
    "word_length": (14.0, 10.0),
    "short_words": (0.70, 0.50),
}
_NAMES = list(LABELLERS)
_STEPS = 24


def measures(plain: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A row of measures per text, in the order of ``LABELLERS``; and (text number, shape) of every word."""
    data = np.frombuffer(b"\n".join(plain) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]

    def total(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), starts)

    symbol, letter, upper = _SYMBOL[data], _LETTER[data], _UPPER[data]
    visible = np.maximum(total(~_SPACE[data]), 1)
    doubled = symbol.copy()
    doubled[1:] &= data[1:] == data[:-1]
    doubled[0] = False
    hashes, first = word_hashes(plain)
    counts = np.diff(first)
    words = np.maximum(counts, 1)
    text_of = np.repeat(np.arange(len(plain)), counts)
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    keys, times = np.unique(mix(hashes ^ text_of.astype(np.uint64)), return_counts=True, return_index=True)[1:]
    distinct = np.bincount(text_of[keys], minlength=len(plain))
    most = np.zeros(len(plain), dtype=np.int64)
    np.maximum.at(most, text_of[keys], times)
    lines = [t.split(b"\n") for t in plain]
    lines = [[x for x in ls if x] for ls in lines]
    repeated = np.array([1 - len(set(ls)) / len(ls) if ls else 0.0 for ls in lines])

    # Every word's share of capitals, symbols and digits, from running sums.
    blank = _SPACE[data]
    before = np.concatenate([[True], blank[:-1]])
    word_starts, word_ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    lengths = word_ends - word_starts

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[word_ends] - sums[word_starts]

    def grade(part: np.ndarray) -> np.ndarray:
        return (part > 0).astype(np.int64) + (part > 1) + (2 * part >= lengths)

    word_of = np.searchsorted(starts, word_starts, side="right") - 1
    marks = inside(~(letter | _DIGIT[data] | blank))
    shape = ((np.minimum(lengths, 23) // 3) * 4 + grade(inside(upper))) * 4 + grade(marks)
    shape = shape * 4 + grade(inside(_DIGIT[data]))
    per_text = [
        total_words / words for total_words in (
            np.bincount(text_of, weights=same, minlength=len(plain)), most - (counts > 0), distinct,
        )
    ]
    table = np.stack([
        *per_text,
        total(upper & ~before) / np.maximum(total(letter & (data < 128)), 1),
        total(symbol) / visible,
        total(doubled) / visible,
        total(data == ord("!")) / words,
        total(data == ord("|")) / words,
        total(letter | _COMMON_MARKS[data]) / visible,
        repeated,
        counts.astype(float),
        np.bincount(word_of, weights=lengths, minlength=len(plain)) / words,
        np.bincount(word_of, weights=lengths <= 2, minlength=len(plain)) / words,
    ], axis=1)
    return table, (word_of, shape)


def votes(table: np.ndarray) -> np.ndarray:
    """1 for bad, 0 for good, -1 for neither."""
    out = np.full(table.shape, -1, dtype=np.int8)
    for j, (bad, good) in enumerate(LABELLERS.values()):
        rising = bad > good
        out[table[:, j] <= good if rising else table[:, j] >= good, j] = 0
        out[table[:, j] >= bad if rising else table[:, j] <= bad, j] = 1
    return out


def features(table: np.ndarray, words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs. A measure gives a feature for each step it reaches, a word shape one
    for each halving of its share that it does not fall below."""
    # Slices of nothing but empty texts have no feature at all.
    rows, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

    def add(row: np.ndarray, name: np.ndarray, step: np.ndarray) -> None:
        for at in range(1, _STEPS + 1):
            hit = step >= at
            if not hit.any():
                break
            rows.append(row[hit])
            parts.append(mix((name[hit].astype(np.uint64) << np.uint64(8)) + np.uint64(at)))

    everyone = np.arange(len(table))
    for j in range(table.shape[1]):
        value = table[:, j]
        scaled = np.log2(value + 1) * 2 if _NAMES[j] in ("words", "word_length") else np.sqrt(value) * _STEPS
        add(everyone, np.full(len(table), 1 << 20 | j), np.floor(scaled))
    word_of, shape = words
    keys, times = np.unique((word_of.astype(np.int64) << 20) | shape, return_counts=True)
    row = keys >> 20
    share = times / np.maximum(np.bincount(word_of, minlength=len(table)), 1)[row]
    add(row, keys & ((1 << 20) - 1), np.floor(8 + np.log2(share)))
    return np.concatenate(rows), np.concatenate(parts)


def learn(docs: DataFrame, *, sample: int = SAMPLE) -> tuple[LabelModel, Linear]:
    """Label model from the votes on all documents, scorer from about ``sample`` of them (at most twice as many)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            for part in slices(batch, "text"):
                table, _ = measures(raw(part.column("text")))
                codes, number = np.unique(encode(votes(table)), return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": codes, "n": number})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            for part in slices(batch, "text"):
                table, words = measures(raw(part.column("text")))
                row, found = features(table, words)
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(table) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(encode(votes(table))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(found[order].view(np.int64))),
                ], names=["code", "features"])

    labellers = len(LABELLERS)
    patterns = (
        docs.select("text").mapInArrow(count, "code bigint, n bigint").groupBy("code")
        .agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    )
    seen = decode(patterns["code"].to_numpy(dtype=np.int64), labellers)
    number = patterns["n"].to_numpy(dtype=float)
    model = fit(seen, number, one_class_per_fault)
    chosen = thinned(docs, ["doc_id", "text"], sample, int(number.sum())).limit(2 * sample)
    known = chosen.select("text").mapInArrow(describe, "code bigint, features array<bigint>").toPandas()
    known = known.sort_values("code", kind="stable")
    posterior = 1 - model.posterior(decode(known["code"].to_numpy(dtype=np.int64), labellers))
    rows = [np.array(r, dtype=np.int64).view(np.uint64) for r in known["features"]]
    every = np.unique(np.concatenate(rows)) if rows else np.zeros(0, dtype=np.uint64)
    return model, train(rows, posterior, every)


def score(
    docs: DataFrame, *, cut: float = CUT, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: better), ``posterior`` (of the labellers alone) and ``keep``.

    ``keep`` is whether the score reaches ``cut``. Null and empty texts are texts without words, which the
    labellers judge like any other. Repeated rows are scored each; an empty table gives no rows.
    """
    rows = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model, scorer = learn(rows, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for batch in batches:
            for part in slices(batch, "text"):
                table, words = measures(raw(part.column("text")))
                found = scorer.score(len(table), *features(table, words))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(found), pa.array(1 - model.posterior(votes(table))),
                    pa.array(found >= cut),
                ], names=["doc_id", "score", "posterior", "keep"])

    return rows.mapInArrow(run, "doc_id bigint, score double, posterior double, keep boolean")
