"""Near copies by ProbMinHash signatures, banding and exact verification.

A text is its set of five-word shingles, each weighted 1 + ln(occurrences). The similarity of two texts
is the probability Jaccard of these weights: the sum over common shingles d of
1 / sum over all d' of max(w(d')/w(d), v(d')/v(d)); with equal weights that is the plain Jaccard index.

Signatures: every shingle is a Poisson process of arrivals with its weight as rate, each arrival falls
on a random component, and a component keeps the shingle that comes first. Two texts agree in a
component with just the probability that is their similarity. A shingle stops as soon as its next
arrival is later than the last first arrival of all components (early termination).

Groups stay whole without pairs inside them. Equal texts are one text from the start. A bucket of a band
has a hub, the text that meets most others over all its buckets: in a group of copies the original,
which is nearer to every copy than they are to each other. Texts are compared with hubs, first each
with the strongest hub of all its buckets, then with the others where the two are not in one class
yet. What is left are texts of a bucket in different classes. Of those, only pairs become rows
whose signatures agree nearly as often as the threshold asks (five standard deviations below it; a
link at the very threshold fails that in three of ten million cases) and whose distances from the
bucket's hub do not differ by more than the threshold allows: the distance is a metric, so for the
others the triangle inequality rules a link out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gainsay.llm.common import begin, raw, slices, staged, texts
from gainsay.llm.shingles import mix, weighted_sets

BANDS, ROWS = 36, 6
# Signatures have this many times the components that the bands use; the more, the closer the estimate.
PRECISION = 2
THRESHOLD = 0.8
# Similarities are sums of floats: a pair on the edge is linked, and compared rather than ruled out.
_SLACK = 1e-9

_DEVIATIONS = 5

_SIGNED = "row_id bigint, doc_id bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>"


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signatures(texts_: list[bytes], components: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``components`` shingle ids per text, and which texts have any shingle."""
    text_of, ids, counts = weighted_sets(texts_)
    rate = weights(counts)
    first = np.full(len(texts_) * components, np.inf)
    owner = np.zeros(len(texts_) * components, dtype=np.uint64)
    alive = np.arange(len(ids))
    time = np.zeros(len(ids))
    seed = mix(ids)
    arrival = 0
    while len(alive):
        arrival += 1
        # One hash gives the waiting time and the component of this arrival.
        h = mix(seed[alive] + np.uint64((arrival * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)))
        uniform = ((h >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40
        time[alive] -= np.log(uniform) / rate[alive]
        t = time[alive]
        h = mix(h + np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
        place = text_of[alive] * components + ((h * np.uint64(components)) >> np.uint64(32)).astype(np.int64)
        better = t < first[place]
        np.minimum.at(first, place[better], t[better])
        won = better & (t == first[place])
        owner[place[won]] = ids[alive][won]
        last = first.reshape(len(texts_), components).max(axis=1)
        alive = alive[t < last[text_of[alive]]]
    some = np.zeros(len(texts_), dtype=bool)
    some[text_of] = True
    return owner.reshape(len(texts_), components), some


def band_keys(owners: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    parts = mix(owners.copy()).reshape(len(owners), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F)
    key = np.broadcast_to(key, parts.shape[:2]).copy()
    for row in range(rows):
        key = mix(key ^ parts[:, :, row]) + np.uint64(row)
    return key.view(np.int64)


def sketches(owners: np.ndarray) -> np.ndarray:
    """One byte of every component's owner, eight to a number."""
    low = (mix(owners.copy()) & np.uint64(0xFF)).astype(np.uint8)
    padding = -low.shape[1] % 8
    return np.pad(low, ((0, 0), (0, padding))).view(np.int64)


def differing(one: Column, other: Column) -> Column:
    """In how many components two sketches differ."""

    def unequal_bytes(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(F.zip_with(one, other, unequal_bytes), F.lit(0), lambda n, m: n + m)


def most_differing(components: int, threshold: float) -> int:
    """Components in which texts at the threshold still may differ."""
    mean, deviation = components * (1 - threshold), (components * threshold * (1 - threshold)) ** 0.5
    return int(mean + _DEVIATIONS * deviation)


def probability_jaccard(
    ids: np.ndarray, w: np.ndarray, other_ids: np.ndarray, v: np.ndarray
) -> float:
    """Exact probability Jaccard of two weighted sets, given as ascending ids and their weights."""
    if not len(ids) and not len(other_ids):
        return 1.0
    _, i, j = np.intersect1d(ids, other_ids, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    a, b = w[i], v[j]
    only_a, only_b = w.sum() - a.sum(), v.sum() - b.sum()
    order = np.argsort(b / a, kind="stable")
    a, b = a[order], b[order]
    # Shingles before d in this order weigh more (relative to d) in the first text, those after it in the second.
    before = np.cumsum(a)
    after = b.sum() - np.cumsum(b)
    return float((1.0 / ((only_a + before) / a + (only_b + after) / b)).sum())


def sign(
    docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: a row number, the text's MD5 as two numbers, its band keys and sketch.

    Texts without words have no keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("probminhash")
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                plain = raw(part.column("text"))
                digests = b"".join(hashlib.md5(t).digest() for t in plain)
                digests = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                owners, some = signatures(plain, PRECISION * bands * rows)
                keys = band_keys(owners[:, : bands * rows], bands, rows)[some]
                sketch = sketches(owners[some])

                def lists(table: np.ndarray) -> pa.ListArray:
                    ends = np.concatenate([[0], np.cumsum(some * table.shape[1])]).astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(table.ravel()))

                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + len(plain))),
                    part.column("doc_id"),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    lists(keys),
                    lists(sketch),
                ], names=["row_id", "doc_id", "d1", "d2", "bands", "sketch"])
                row += len(plain)

    selected = texts(docs, doc_id, text)
    return selected.select(selected.doc_id.cast("bigint"), "text").mapInArrow(run, _SIGNED)


def _similar(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their exact ``similarity``; ``bodies`` has ``text_id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("probminhash")
        for batch in batches:
            for part in slices(batch, "text_b"):
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                plain = {}
                for ids, name in ((a, "text_a"), (b, "text_b")):
                    column = part.column(name)
                    for i, key in enumerate(ids):
                        if key not in plain:
                            plain[key] = column[i].as_py().encode()
                place = {key: i for i, key in enumerate(plain)}
                of, shingles, counts = weighted_sets(list(plain.values()))
                ends = np.searchsorted(of, np.arange(len(plain) + 1))
                weight = weights(counts)

                def weighed(key: int) -> tuple[np.ndarray, np.ndarray]:
                    here = slice(ends[place[key]], ends[place[key] + 1])
                    return shingles[here], weight[here]

                found = [probability_jaccard(*weighed(x), *weighed(y)) for x, y in zip(a, b)]
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "similarity": found})

    left = bodies.select(F.col("text_id").alias("b"), F.col("text").alias("text_b"))
    right = bodies.select(F.col("text_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b").join(left, "b").join(right, "a")
    return both.mapInArrow(run, "a bigint, b bigint, similarity double")


def linked(compared: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``compared`` whose similarity is at least ``threshold``."""
    return compared.filter(F.col("similarity") >= threshold - _SLACK)


def components(links: DataFrame) -> DataFrame:
    """``text_id`` and ``class`` (smallest text_id it is linked with) of every text in ``links`` (a, b)."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.distinct(), "links")
    state = staged(
        both.groupBy(F.col("a").alias("text_id")).agg(F.least("text_id", F.min("b")).alias("class")),
        "classes",
    )
    while True:
        # The smallest class among the neighbours, then the class of that text.
        near = both.join(state.withColumnRenamed("text_id", "b"), "b").groupBy(
            F.col("a").alias("text_id")
        ).agg(F.min("class").alias("near"))
        lower = state.join(near, "text_id").select(
            "text_id", F.col("class").alias("old"), F.least("class", "near").alias("via")
        )
        up = state.select(F.col("text_id").alias("via"), F.col("class").alias("up"))
        after = staged(
            lower.join(up, "via").select("text_id", "old", F.least("via", "up").alias("class")),
            "classes",
        )
        state = after.select("text_id", "class")
        if after.filter(F.col("old") != F.col("class")).isEmpty():
            return state


def near_copies(
    docs: DataFrame,
    *,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``class_id``, ``class_size``, ``kept`` and the text's ``md5``.

    A class holds the texts that are linked, directly or through others, by a similarity of at least
    ``threshold``, and all their exact copies; its id is its smallest doc_id and its size counts rows.
    ``kept`` marks one row of each class: its smallest doc_id, among repeated rows the first one read.
    Null and empty texts are equal texts without words: copies of each other, near no other text. Rows without
    a doc_id count and are kept only where their class has no other; its class_id is then null. Very
    long texts are compared as a whole. An empty table gives no rows.
    """
    signed = staged(sign(docs, bands=bands, rows=rows, doc_id=doc_id, text=text), "signed")
    copies = signed.groupBy("d1", "d2").agg(
        F.min("row_id").alias("text_id"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")
    )
    copies = staged(copies, "copies")

    distinct = signed.join(copies.select(F.col("text_id").alias("row_id")), "row_id", "left_semi")
    members = distinct.select(F.col("row_id").alias("text_id"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    met = staged(members.join(shared, "bucket"), "met")
    degrees = met.groupBy("text_id").agg(F.sum("size").alias("degree"))
    hubs = (
        met.join(degrees, "text_id")
        .groupBy("bucket")
        .agg(F.max(F.struct("degree", "text_id")).alias("hub"))
        .select("bucket", F.col("hub.text_id").alias("hub"), F.col("hub.degree").alias("degree"))
    )
    buckets = staged(met.select("bucket", "text_id").join(hubs, "bucket"), "buckets")

    # The texts of all buckets, each once.
    wanted = copies.join(buckets.select("text_id").distinct(), "text_id", "left_semi")
    own = texts(docs, doc_id, text).select(
        F.col("doc_id").cast("bigint").alias("own_id"), F.md5("text").alias("md5"), "text"
    )
    keys = wanted.select("text_id", "doc_id", _hex("d1", "d2").alias("key"))
    bodies = staged(
        own.join(
            keys, (F.col("md5") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("doc_id"))
        )
        .groupBy("md5", "own_id")
        .agg(F.first("text_id").alias("text_id"), F.first("text").alias("text"))
        .select("text_id", "text"),
        "bodies",
    )

    stars = buckets.filter(F.col("text_id") != F.col("hub"))
    nearest = stars.groupBy("text_id").agg(F.max(F.struct("degree", "hub"))["hub"].alias("hub"))
    compared = staged(_similar(_ordered(nearest, "text_id", "hub"), bodies), "compared")
    classes = components(linked(compared, threshold))

    again = _ordered(stars, "text_id", "hub").join(compared, ["a", "b"], "left_anti")
    again = apart(again, classes)
    compared = staged(compared.unionByName(_similar(again, bodies)), "compared")
    classes = components(linked(compared, threshold))

    signs = distinct.select(F.col("row_id").alias("text_id"), "bands", "sketch")
    rest = crossing(buckets, signs, compared, classes, threshold, most_differing(PRECISION * bands * rows, threshold))
    rest = rest.join(compared, ["a", "b"], "left_anti")
    compared = staged(compared.unionByName(_similar(rest, bodies)), "compared")
    classes = components(linked(compared, threshold))

    grouped = copies.join(classes, "text_id", "left").withColumn("class", F.coalesce("class", "text_id"))
    sizes = grouped.groupBy("class").agg(
        F.min("doc_id").alias("class_id"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id"))["text_id"].alias("kept_text"),
        F.sum("copies").alias("class_size"),
    )
    # The first row of the kept text that has the class's smallest doc_id.
    known = grouped.join(sizes, "class").select("d1", "d2", "class_id", "class_size", (F.col("text_id") == F.col("kept_text")).alias("kept_class"))
    marked = signed.select("row_id", "doc_id", "d1", "d2").join(known, ["d1", "d2"])
    firsts = (
        marked.filter(F.col("kept_class") & F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("d1", "d2")
        .agg(F.min("row_id").alias("row_id"))
        .select("row_id", F.lit(True).alias("kept"))
    )
    return marked.join(firsts, "row_id", "left").select(
        "doc_id", "class_id", "class_size", F.coalesce("kept", F.lit(False)).alias("kept"),
        _hex("d1", "d2").alias("md5"),
    )


def _hex(*numbers: str):
    """The hexadecimal digits of numbers that hold eight bytes in little-endian order each."""
    digits = [F.lpad(F.lower(F.hex(n)), 16, "0") for n in numbers]
    return F.concat(*[
        F.substring(d, 15 - 2 * byte, 2) for d in digits for byte in range(8)
    ])


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Distinct pairs (a, b) with the smaller text number first."""
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` whose texts are not in one class yet."""
    for side in ("a", "b"):
        of = classes.select(F.col("text_id").alias(side), F.col("class").alias(f"class_{side}"))
        pairs = pairs.join(of, side, "left")
    different = F.coalesce("class_a", "a") != F.coalesce("class_b", "b")
    return pairs.filter(different).select("a", "b")


def crossing(
    buckets: DataFrame,
    signs: DataFrame,
    compared: DataFrame,
    classes: DataFrame,
    threshold: float,
    most: int,
) -> DataFrame:
    """Pairs (a, b) of texts that share a bucket, are in different classes, and may still be similar.

    A bucket whose texts are all in one class gives none, and a pair comes from the first bucket that it
    shares. A text that was in one class with the bucket's hub before the two were compared has an
    unknown similarity to it: anything from 0 to 1.
    """
    labelled = buckets.join(classes, "text_id", "left").withColumn(
        "class", F.coalesce("class", "text_id")
    )
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"))
        .filter(F.col("low") < F.col("high"))
        .select("bucket")
    )
    rows = (
        labelled.filter(F.col("text_id") != F.col("hub"))
        .join(mixed, "bucket", "left_semi")
        .withColumns({"a": F.least("text_id", "hub"), "b": F.greatest("text_id", "hub")})
        .join(compared, ["a", "b"], "left")
        .join(signs, "text_id")
        .select(
            "bucket", "text_id", "class", "sketch",
            F.coalesce(F.col("similarity"), F.lit(0.0)).alias("low"),
            F.coalesce(F.col("similarity"), F.lit(1.0)).alias("high"),
            F.slice("bands", F.lit(1), F.array_position("bands", F.col("bucket")).cast("int") - 1).alias("earlier"),
        )
    )
    rows = staged(rows, "crossing")
    left, right = rows.alias("l"), rows.alias("r")
    reach = 1 - threshold + _SLACK
    may_link = (
        (F.col("l.bucket") == F.col("r.bucket"))
        & (F.col("l.text_id") < F.col("r.text_id"))
        & (F.col("l.class") != F.col("r.class"))
        & (F.col("l.low") - F.col("r.high") <= reach)
        & (F.col("r.low") - F.col("l.high") <= reach)
        & (differing(F.col("l.sketch"), F.col("r.sketch")) <= most)
        & ~F.arrays_overlap("l.earlier", "r.earlier")
    )
    pairs = left.join(right, may_link)
    return pairs.select(F.col("l.text_id").alias("a"), F.col("r.text_id").alias("b"))
