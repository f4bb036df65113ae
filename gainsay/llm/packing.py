"""Packing documents into sequences of several lengths, with whole windows and no padding.

A document gives full windows of the longest length; what is left is routed to the shortest tier that
holds it. Tiers are packed from long to short: a window starts with the longest open piece of its
tier, gaps are filled with the longest whole pieces that fit, the tier's own or shorter ones, and only
where none fits is a piece cut to close the window. The sequences of a block are then dealt to step
groups of about equal tokens and attention cost.

Everything happens where the documents are read: one pass without a shuffle. A task holds one block
(a bound on tokens, not on documents) and less than one long window carried over from the last.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gainsay.llm.common import begin, raw, slices, texts
from gainsay.llm.tokens import SLICE_BYTES, default_path, encoder

TIERS = (512, 1024, 2048, 4096)
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 32 * 4096
END_ID = 2

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("sequence_tokens", pa.int64()), ("step_group", pa.int64()),
])
SPARK_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, sequence_tokens bigint, step_group bigint"
)

# A piece: its length, a number that keeps pieces of one length apart, document, start, ids, document length.
Piece = tuple[int, int, int | None, int, bytes, int]


class Packer:
    """Windows of the given tiers from a stream of documents."""

    def __init__(self, tiers: Sequence[int] = TIERS):
        self.tiers = sorted(tiers)
        self.pools: dict[int, list[Piece]] = {tier: [] for tier in self.tiers}
        self.windows: list[list[Piece]] = []
        self.tokens = 0
        self._number = 0
        self._left: list[Piece] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        longest, total = self.tiers[-1], len(ids) // 4
        self.tokens += total
        whole = total // longest * longest
        for start in range(0, whole, longest):
            self.windows.append([self._piece(doc_id, start, ids[4 * start : 4 * (start + longest)], total)])
        if whole < total:
            self._route(self._piece(doc_id, whole, ids[4 * whole :], total))

    def close(self, last: bool) -> list[list[Piece]]:
        """The finished windows; at the ``last`` call also what was left, at lengths that are powers of two."""
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                window = [self.pools[tier].pop()]
                gap = tier - window[0][0]
                while gap and (piece := self._fitting(gap, tier) or self._cut(gap, tier)):
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    self._keep(window, last)
                    break
                self.windows.append(window)
        done, self.windows, self.tokens = self.windows, [], 0
        if not last:
            for piece in self._left:
                self._route(piece)
        self._left = []
        return done

    def _keep(self, window: list[Piece], last: bool) -> None:
        """Nothing is left to fill this window: every pool of its tier and below is empty."""
        if not last:
            self._left = [*self._left, *window]
            return
        pieces = window[::-1]
        rest = sum(piece[0] for piece in pieces)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            filled: list[Piece] = []
            while room:
                piece = pieces.pop()
                if piece[0] > room:
                    piece, after = self._split(piece, room)
                    pieces.append(after)
                filled.append(piece)
                room -= piece[0]
            self.windows.append(filled)

    def _piece(self, doc_id: int | None, start: int, ids: bytes, total: int) -> Piece:
        self._number += 1
        return len(ids) // 4, self._number, doc_id, start, ids, total

    def _route(self, piece: Piece) -> None:
        insort(self.pools[next(t for t in self.tiers if t >= piece[0])], piece, key=lambda p: p[:2])

    def _fitting(self, gap: int, tier: int) -> Piece | None:
        for shorter in reversed(self.tiers):
            if shorter <= tier and (at := bisect_right(self.pools[shorter], gap, key=lambda p: p[0])):
                return self.pools[shorter].pop(at - 1)
        return None

    def _cut(self, gap: int, tier: int) -> Piece | None:
        """``gap`` tokens of the longest piece of a shorter tier, or of this one if those are empty."""
        open_tiers = [t for t in self.tiers if t <= tier and self.pools[t]]
        if not open_tiers:
            return None
        shorter = [t for t in open_tiers if t < tier]
        piece, rest = self._split(self.pools[(shorter or open_tiers)[-1]].pop(), gap)
        self._route(rest)
        return piece

    def _split(self, piece: Piece, at: int) -> tuple[Piece, Piece]:
        _, _, doc_id, start, ids, total = piece
        return (
            self._piece(doc_id, start, ids[: 4 * at], total),
            self._piece(doc_id, start + at, ids[4 * at :], total),
        )


def balance(windows: list[list[Piece]], step_tokens: int) -> list[int]:
    """A step group for every window: groups get about equal tokens, then about equal attention cost."""
    sizes = [sum(p[0] for p in window) for window in windows]
    costs = [sum(p[0] ** 2 for p in window) for window in windows]
    groups = max(1, round(sum(sizes) / step_tokens))
    loads = [(0, 0, group) for group in range(groups)]
    chosen = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-sizes[i], -costs[i])):
        tokens, cost, group = loads[0]
        heapq.heapreplace(loads, (tokens + sizes[i], cost + costs[i], group))
        chosen[i] = group
    return chosen


def pack(
    docs: DataFrame,
    *,
    tokenizer: str | None = None,
    tiers: Sequence[int] = TIERS,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece of a document, with its ids and its place in a sequence.

    ``tiers`` are powers of two. Every row is a document of its own, repeated rows and null ids too; a
    null or empty text is just ``end_id``. An empty table gives no rows. A long text is cut into as many
    pieces as it needs. ``step_group`` and ``sequence_id`` are unique over the whole result.
    """
    if any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    path, end = tokenizer or default_path(), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        encode, packer = encoder(path).encode, Packer(tiers)
        base = TaskContext.get().partitionId() << 36
        sequences = groups = base

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal sequences, groups
            windows = packer.close(last)
            chosen = balance(windows, step_tokens)
            out: list[tuple] = []
            for window, group in zip(windows, chosen):
                offset, size = 0, sum(p[0] for p in window)
                for length, _, doc, start, ids, total in window:
                    out.append((doc, start, length, ids, total, sequences, offset, size, groups + group))
                    offset += length
                sequences += 1
            groups += max(chosen, default=-1) + 1
            columns = list(zip(*out)) or [[]] * len(SCHEMA)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA
            )

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                encoded = encode(raw(part.column("text")))
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    packer.add(doc, ids + end)
                if packer.tokens >= block_tokens:
                    yield rows(last=False)
        yield rows(last=True)

    selected = texts(docs, doc_id, text)
    return selected.select(selected.doc_id.cast("bigint"), "text").mapInArrow(run, SPARK_SCHEMA)
