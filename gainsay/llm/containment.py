"""Short test items inside long documents: size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles, into classes of at most 16, 64, 256, ...
For a class of at most u shingles, documents are seen as windows of 4u following shingles that overlap
by u, so an item lies whole in a window not much larger than itself and their resemblance does not
sink with the length of the document. Items and windows have one-permutation MinHash signatures: of
the shingles whose id falls in a bin, the smallest. An item and a window that agree in any bin are a
candidate, and every candidate is verified by the words themselves: the share of the item's shingles
that the whole document holds.

The few shingles of the items of the smallest class are too few for that: one in five is not the smallest of
its bin. These items keep all their shingles and documents need no windows: a candidate is a document
that holds as many of them as the threshold asks, so none is missed.

A window's signature is only asked for where one of its shingles is in some item's signature, since
they cannot agree otherwise. The items are a stated query set: they go to the tasks in blocks of
bounded size, one pass over the documents per block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gainsay.llm.common import begin, raw, slices, staged, texts
from gainsay.llm.shingles import ID_BITS, WIDTH, shingle_hashes, weighted_sets, word_shingles

THRESHOLD = 0.8
SMALLEST_CLASS = 16
WINDOW, BINS = 4, 8
BLOCK_SHINGLES = 1 << 19

_FILTER_BITS = 22
_FOUND = "doc_id bigint, item_id bigint, containment double, item_shingles bigint"

Item = tuple[int | None, str]


def item_blocks(items: Iterable[Item], block_shingles: int) -> Iterator[list[Item]]:
    """Items in lists of about so many words."""
    block: list[Item] = []
    held = 0
    for item_id, text in items:
        block.append((item_id, text))
        held += len(text.split())
        if held >= block_shingles:
            yield block
            block, held = [], 0
    if block:
        yield block


class SizeClass:
    """Signatures of the items of one size class."""

    def __init__(self, largest: int):
        self.window, self.stride = WINDOW * largest, (WINDOW - 1) * largest
        self.bins = np.uint64(BINS * largest)
        self._pairs: list[tuple[int, int]] = []

    def add(self, item: int, ids: np.ndarray) -> None:
        """Keep the smallest id of every bin."""
        ids = np.sort(ids)
        _, first = np.unique(ids % self.bins, return_index=True)
        self._pairs += [(int(i), item) for i in ids[first]]

    def build(self) -> SizeClass:
        pairs = sorted(self._pairs)
        self.ids = np.array([i for i, _ in pairs], dtype=np.uint64)
        self.items = np.array([item for _, item in pairs], dtype=np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.ids & np.uint64((1 << _FILTER_BITS) - 1)] = True
        return self

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Places of shingles that are in some item's signature."""
        at = np.flatnonzero(self.filter[ids & np.uint64((1 << _FILTER_BITS) - 1)])
        found = np.searchsorted(self.ids, ids[at])
        return at[self.ids[np.minimum(found, len(self.ids) - 1)] == ids[at]]

    def candidates(
        self, ids: np.ndarray, text_of: np.ndarray, first: np.ndarray
    ) -> set[tuple[int, int]]:
        """Text and item numbers whose signatures agree in a bin of some window."""
        hits = self.hits(ids)
        if not len(hits):
            return set()
        place = hits - first[text_of[hits]]
        last = place // self.stride
        both = np.concatenate([last, last - 1])
        at = np.concatenate([hits, hits])
        inside = (both >= 0) & (np.concatenate([place, place]) < both * self.stride + self.window)
        at, both = at[inside], both[inside]
        starts = first[text_of[at]] + both * self.stride
        windows, window_of = np.unique(starts, return_inverse=True)
        ends = np.minimum(windows + self.window, first[text_of[windows] + 1])
        lengths = ends - windows
        shift = np.cumsum(lengths) - lengths
        flat = np.arange(int(lengths.sum())) + np.repeat(windows - shift, lengths)
        owner = np.repeat(np.arange(len(windows)), lengths)
        bins = int(self.bins)
        smallest = np.full(len(windows) * bins, np.uint64((1 << 64) - 1))
        np.minimum.at(smallest, owner * bins + (ids[flat] % self.bins).astype(np.int64), ids[flat])
        agree = smallest[window_of * bins + (ids[at] % self.bins).astype(np.int64)] == ids[at]
        found: set[tuple[int, int]] = set()
        for i in np.unique(at[agree]).tolist():
            low, high = np.searchsorted(self.ids, ids[i]), np.searchsorted(self.ids, ids[i], side="right")
            found.update((int(text_of[i]), item) for item in self.items[low:high].tolist())
        return found


class ShortItems(SizeClass):
    """All shingles of the items of the smallest class."""

    def __init__(self, exact: list[set[tuple[str, ...]]], threshold: float):
        super().__init__(SMALLEST_CLASS)
        self.exact, self.threshold = exact, threshold
        self._least: dict[int, int] = {}

    def add(self, item: int, ids: np.ndarray) -> None:
        """Keep every id, and how many of them a document has that holds enough of the item's shingles."""
        self._pairs += [(int(i), item) for i in ids]
        number = len(self.exact[item])
        enough = next((n for n in range(1, number) if n / number >= self.threshold), number)
        # Shingles of one id count once.
        self._least[item] = max(enough - (number - len(ids)), 1)

    def candidates(
        self, ids: np.ndarray, text_of: np.ndarray, first: np.ndarray
    ) -> set[tuple[int, int]]:
        """Text and item numbers where the text has enough of the item's ids."""
        at = self.hits(ids)
        if not len(at):
            return set()
        held = np.unique(np.stack([text_of[at].astype(np.int64), ids[at].astype(np.int64)]), axis=1)
        texts_, wanted = held[0], held[1].astype(np.uint64)
        low = np.searchsorted(self.ids, wanted)
        many = np.searchsorted(self.ids, wanted, side="right") - low
        shift = np.cumsum(many) - many
        items = self.items[np.arange(int(many.sum())) + np.repeat(low - shift, many)]
        pairs, counts = np.unique(np.stack([np.repeat(texts_, many), items]), axis=1, return_counts=True)
        return {
            (text, item)
            for text, item, count in zip(*pairs.tolist(), counts.tolist())
            if count >= self._least[item]
        }


class Index:
    """Size classes and exact shingles of a block of items."""

    def __init__(self, items: list[Item], width: int, threshold: float):
        self.item_ids = [item_id for item_id, _ in items]
        self.exact = [word_shingles(text, width) for _, text in items]
        classes: dict[int, SizeClass] = {}
        text_of, ids, _ = _sets([text.encode() for _, text in items], width)
        for item in np.unique(text_of).tolist():
            own = ids[text_of == item]
            largest = SMALLEST_CLASS
            while largest < len(own):
                largest *= 4
            if largest not in classes:
                short = largest == SMALLEST_CLASS
                classes[largest] = ShortItems(self.exact, threshold) if short else SizeClass(largest)
            classes[largest].add(item, own)
        self.classes = [c.build() for c in classes.values()]


def _sets(plain: list[bytes], width: int):
    parts = [weighted_sets(plain[i : i + 4096], width) for i in range(0, len(plain), 4096)]
    moved = [(of + 4096 * n, ids, counts) for n, (of, ids, counts) in enumerate(parts)]
    return tuple(map(np.concatenate, zip(*moved)))


def contained(
    docs: DataFrame,
    items: DataFrame,
    *,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    block_shingles: int = BLOCK_SHINGLES,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``threshold``.

    ``doc_id``, ``item_id``, ``containment`` (the exact share of the item's distinct shingles) and
    ``item_shingles``. An item without words is in no document; one of fewer words than a shingle is only
    found in documents that consist of just these words. Repeated documents and items give a row each;
    documents and items without an id are searched like the others. Empty tables give no rows.
    """

    def found_in(block: list[Item]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("containment")
            index = Index(block, width, threshold)
            for batch in batches:
                for part in slices(batch, "text"):
                    yield _pairs(index, part, threshold, width)

        selected = texts(docs, doc_id, text)
        return selected.select(selected.doc_id.cast("bigint"), "text").mapInArrow(run, _FOUND)

    blocks = item_blocks(_items(items, item_id, item_text), block_shingles)
    found = [staged(found_in(block), "contained") for block in blocks]
    if not found:
        return docs.sparkSession.createDataFrame([], _FOUND)
    return reduce(DataFrame.unionAll, found)


def without_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    block_shingles: int = BLOCK_SHINGLES,
    text: str = "text",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold less than ``threshold`` of every item (see ``contained``)."""

    def clean_of(rows: DataFrame, block: list[Item]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("containment")
            index = Index(block, width, threshold)
            for batch in batches:
                place = batch.schema.get_field_index(text)
                for part in slices(batch, text):
                    plain = [t or b"" for t in raw(part.column(place))]
                    keep = np.ones(len(plain), dtype=bool)
                    keep[[row for row, *_ in _matches(index, plain, threshold, width)]] = False
                    yield part.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    rest = docs
    blocks = item_blocks(_items(items, None, item_text), block_shingles)
    for n, block in enumerate(blocks):
        rest = clean_of(staged(rest, "clean") if n else rest, block)
    return rest


def _items(items: DataFrame, item_id: str | None, item_text: str) -> Iterator[Item]:
    key = F.col(item_id) if item_id else F.lit(None)
    wanted = items.select(
        key.cast("bigint").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    )
    return ((row["item_id"], row["text"]) for row in wanted.toLocalIterator())


def _matches(
    index: Index, plain: list[bytes], threshold: float, width: int
) -> Iterator[tuple[int, int, float, int]]:
    """Text number, item number, containment and number of item shingles of every verified pair."""
    text_of, hashes = shingle_hashes(plain, width)
    ids = hashes >> np.uint64(64 - ID_BITS)
    first = np.searchsorted(text_of, np.arange(len(plain) + 1))
    wanted: dict[int, set[int]] = defaultdict(set)
    for size_class in index.classes:
        for text, item in size_class.candidates(ids, text_of, first):
            wanted[text].add(item)
    for text in sorted(wanted):
        whole = word_shingles(plain[text].decode("utf-8", "replace"), width)
        for item in sorted(wanted[text]):
            exact = index.exact[item]
            share = len(exact & whole) / len(exact)
            if share >= threshold:
                yield text, item, share, len(exact)


def _pairs(index: Index, part: pa.RecordBatch, threshold: float, width: int) -> pa.RecordBatch:
    doc_ids = part.column("doc_id")
    rows = [
        (doc_ids[text].as_py(), index.item_ids[item], share, number)
        for text, item, share, number in _matches(index, raw(part.column("text")), threshold, width)
    ]
    names = ["doc_id", "item_id", "containment", "item_shingles"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, types)], names=names
    )
