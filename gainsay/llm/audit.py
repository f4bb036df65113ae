"""How filters interact: what every order of five filters removes, step by step.

Whether a document fails a filter does not depend on the order, so its failures are found once, as a
mask of five bits, and documents shrink to counts per part and mask: 32 cells. What is left after a
set of filters is then read off a Gray-code walk over the 32 sets: each step turns one filter on or
off, every cell counts the active filters that it fails, and the survivors run along as cells go from
no active failure to one or back. The states of all sets are kept; a step of an order is the difference of two.

Exact copies (filter E) need no join of documents with documents. Rows shrink first to (id, text), then
to (text, part, labels) with the smallest id and its number of rows, and these are compared per text: a
text that a third of the table repeats is a row per part by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gainsay.llm.common import begin, raw, slices

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = tuple("".join(p) for p in permutations(FILTERS))

# Fixed limits of the filters.
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
_MARKS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))

# Distinct words are gathered from so many bytes of text at a time; longer texts are passed over more often.
WORD_BYTES = 1 << 23
_PIECE = 1 << 20

_CELLS = ("documents", "good", "toxic")
_DIGEST = "doc_id bigint, part string, text_key binary, mask int"
_AUDIT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text (UTF-8) fails."""
    words, distinct = count_words(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    return (
        (words < MIN_WORDS)
        | (100 * distinct < MIN_DISTINCT_PERCENT * words) << 1
        | (100 * upper > MAX_UPPER_PERCENT * points) << 2
        | (len(text.translate(None, _MARKS)) < len(text)) << 3
    )


def count_words(text: bytes, limit: int = WORD_BYTES) -> tuple[int, int]:
    """Words and distinct words between ASCII white space. Of a long text a pass takes the words of one
    class by their checksum, so the distinct ones held at a time stay few."""
    if len(text) <= limit:
        words = text.split()
        return len(words), len(set(words))
    passes = -(-len(text) // limit)
    total = distinct = 0
    for turn in range(passes):
        seen: set[bytes] = set()
        for words in _word_pieces(text):
            total += len(words) if turn == 0 else 0
            seen.update(word for word in words if crc32(word) % passes == turn)
        distinct += len(seen)
    return total, distinct


def _word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of about a megabyte at a time; the last one waits for its end."""
    rest = []
    for at in range(0, len(text), _PIECE):
        piece = text[at : at + _PIECE]
        words = piece.split()
        if not words:
            if rest:
                yield [b"".join(rest)]
                rest = []
            continue
        if rest and piece[:1].isspace():
            yield [b"".join(rest)]
            rest = []
        if len(words) == 1 and not piece[-1:].isspace():
            rest.append(words[0])
            continue
        words[0] = b"".join([*rest, words[0]])
        rest = [] if piece[-1:].isspace() else [words.pop()]
        yield words
    if rest:
        yield [b"".join(rest)]


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, a hash of the whole text, and the mask of filters A to D."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("audit")
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = raw(piece.column("text"))
                yield pa.record_batch({
                    "doc_id": piece.column("doc_id"),
                    "part": piece.column("part"),
                    "text_key": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    "mask": pa.array(map(failures, texts), pa.int32()),
                })

    return rows.mapInArrow(run, _DIGEST)


def cells(digests: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per part and mask of failed filters, E with them.

    Of several labels of a document any counts. A null ``doc_id`` has no label and is nobody's copy.
    """
    good, toxic = ((F.max(F.coalesce(F.col(c) == 1, F.lit(False)))) for c in ("quality", "toxic"))
    marks = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic")
        .filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(good.alias("good"), toxic.alias("toxic"))
        .filter("good OR toxic")
    )
    # Repeated rows become one with a number, so a repeated id is no hot key of the join; nor is no id.
    rows = digests.groupBy("doc_id", "part", "text_key", "mask").agg(F.count(F.lit(1)).alias("documents"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text_key")).otherwise(F.lit(0))
    marks = marks.withColumn("spread", F.lit(0).cast("bigint"))
    no = F.lit(False)
    marked = rows.withColumn("spread", spread).join(marks, ["doc_id", "spread"], "left").withColumns(
        {"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)}
    )
    copies = marked.groupBy("text_key", "part", "good", "toxic").agg(
        F.first("mask").alias("mask"),
        F.sum("documents").alias("documents"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("documents")).otherwise(F.lit(0))).alias("unnamed"),
        F.min("doc_id").alias("smallest"),
        # Rows of one id, text and part are one row here, so this is their number.
        F.min_by("documents", "doc_id").alias("of_smallest"),
    )
    first = F.min("smallest").over(Window.partitionBy("text_key"))
    passing = F.col("unnamed") + F.when(F.col("smallest") == first, F.col("of_smallest")).otherwise(F.lit(0))
    counted = (
        copies.withColumn("passing", passing)
        .select(
            "good", "toxic", "part",
            F.inline(F.array(
                F.struct("mask", F.col("passing").alias("n")),
                F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("documents") - F.col("passing")).alias("n")),
            )),
        )
        .filter("n > 0")
    )
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("documents"), when("good").alias("good"), when("toxic").alias("toxic")
    )


def walk(cells: np.ndarray) -> np.ndarray:
    """What survives every set of filters. ``cells``: parts x masks x counts; so is the result, by set."""
    parts, masks, counts = cells.shape
    states = np.empty((masks, parts, counts), dtype=np.int64)
    failing = np.zeros(masks, dtype=np.int64)
    survivors = cells.sum(axis=1)
    states[0] = survivors
    place = np.arange(masks)
    for turn in range(1, masks):
        now, bit = turn ^ (turn >> 1), turn & -turn
        hit = (place & bit) != 0
        if now & bit:
            survivors = survivors - cells[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            survivors = survivors + cells[:, hit & (failing == 0)].sum(axis=1)
        states[now] = survivors
    return states


def steps(states: np.ndarray, cells: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of all steps of all orders, each parts x orders x steps, from the states of the sets."""
    bits = np.array([[1 << FILTERS.index(letter) for letter in order] for order in ORDERS])
    after = np.cumsum(bits, axis=1)
    left = states[after].transpose(2, 0, 1, 3)
    lost = states[after - bits].transpose(2, 0, 1, 3) - left
    place = np.arange(SETS)
    fails = np.stack([cells[:, (place & bit) != 0, 0].sum(axis=1) for bit in 1 << np.arange(len(FILTERS))], axis=1)
    only = cells[:, 1 << np.arange(len(FILTERS)), 0]
    filters = np.log2(bits).astype(int)
    shapley = np.stack([lost[:, filters == f, 0].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": left[..., 0], "removed": lost[..., 0], "redundant": fails[:, filters] - lost[..., 0],
        "unique_fails": only[:, filters], "good_lost": lost[..., 1], "toxic_lost": lost[..., 2],
        "shapley": shapley[:, filters],
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (``lang``), order of the filters and step: what is kept, removed, and lost for nothing.

    Null texts and languages are empty ones; an empty text fails A alone, and E after the first. A
    null ``doc_id`` fails no E and has no label; repeated rows count each and share the fate of their id and
    text. Texts are taken whole, of any length. Columns other than doc_id, text and lang (labels:
    doc_id, quality, toxic) are not read. An empty table gives no rows.
    """
    per_part = cells(digest(docs), labels).groupBy("part").agg(
        F.collect_list(F.struct("mask", *_CELLS)).alias("cells")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("audit")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                table = np.zeros((some.num_rows, SETS, len(_CELLS)), dtype=np.int64)
                for i, found in enumerate(some.column("cells").to_pylist()):
                    for cell in found:
                        table[i, cell["mask"]] = [cell[c] for c in _CELLS]
                columns = steps(walk(table), table)
                rows = len(ORDERS) * len(FILTERS)
                yield pa.record_batch({
                    "part": pa.array(np.repeat(np.array(some.column("part").to_pylist(), dtype=object), rows), pa.string()),
                    "filter_order": pa.array([o for o in ORDERS for _ in FILTERS] * some.num_rows, pa.string()),
                    "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS) * some.num_rows), pa.int32()),
                    **{name: pa.array(values.reshape(-1), pa.int64()) for name, values in columns.items()},
                })

    return per_part.mapInArrow(run, _AUDIT)
