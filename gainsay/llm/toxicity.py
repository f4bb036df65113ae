"""Toxicity by weak supervision.

1. A bounded sample of labelled rows gives lexicons: hashed words and word beginnings that are far more
   frequent in toxic texts than in others.
2. Many voters look at every document: parts of the lexicons, and patterns that need no lexicon. Their
   vote patterns are counted over the whole corpus.
3. A generative model learns from these counts how accurate the voters are and which depend on each
   other, with the sample's labels as anchors.
4. Its posterior labels of the sampled texts train a linear scorer over the hashed words and beginnings,
   which then scores every document.

Only a table of vote counts, a few thousand lexicon entries and the bounded sample reach the driver. Labels are
only read for rows outside the held-out third.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gainsay.llm.common import begin, raw, slices, staged, texts, thinned
from gainsay.llm.shingles import mix, prefix_hashes, shingle_hashes
from gainsay.llm.weak import LabelModel, Linear, decode, encode, fit, train, two

SAMPLE_PER_CLASS = 4096
CUT = 0.7
LEAST_RATIO = 8.0
LEAST_EVIDENCE = 14.0
LEXICON = 1 << 14
PARTS = 4

_BEGINNINGS = (4, 5, 6)
_KINDS = 1 + len(_BEGINNINGS)
_SALTS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)
_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[:48] = _SEPARATORS[58:65] = _SEPARATORS[91:97] = _SEPARATORS[123:128] = True

# Voters that look for a form of words rather than for words. 1 where the pattern is found.
PATTERNS = (
    r"(?i)\b(?:you(?:'re| are)|he is|she is|they are) (?:an? )?(?:such |so |just )?(?:an? )?(?:idiot|moron|fool|loser|stupid)",
    r"(?i)\b(?:hate|despise|kill) (?:you|them|him|her)\b",
    r"\b\w[*@#$%]{2,}\w*\b",
    r"(?i)\bshut up\b|\bgo to hell\b",
    r"(?i)\b(?:piece of|full of) (?:trash|crap|garbage)\b",
)
_SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never read."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs: every word and its beginnings, hashed; kinds differ by a salt."""
    words, first, beginnings = prefix_hashes(plain, _SEPARATORS, _BEGINNINGS)
    text_of = np.repeat(np.arange(len(plain)), np.diff(first))
    hashed = [mix(h ^ np.uint64(salt)) for h, salt in zip([words, *beginnings], _SALTS)]
    # The kind is kept in the last two bits.
    marked = [(h & ~np.uint64(3)) | np.uint64(kind) for kind, h in enumerate(hashed)]
    return np.tile(text_of, _KINDS), np.concatenate(marked)


@dataclass
class Voters:
    """Lexicon entries in ascending order, with the part that each belongs to."""

    entries: np.ndarray

    @property
    def number(self) -> int:
        return _KINDS * PARTS + 1 + len(PATTERNS)

    def votes(self, plain: list[bytes]) -> np.ndarray:
        text_of, found = features(plain)
        out = np.full((len(plain), self.number), -1, dtype=np.int8)
        lexicons = _KINDS * PARTS
        any_hit = np.zeros(len(plain), dtype=bool)
        if len(self.entries) and len(found):
            place = np.minimum(np.searchsorted(self.entries, found), len(self.entries) - 1)
            hit = self.entries[place] == found
            entry, text = found[hit], text_of[hit]
            part = (entry & np.uint64(3)) * np.uint64(PARTS) + (entry >> np.uint64(2)) % np.uint64(PARTS)
            out[text, part.astype(np.int64)] = 1
            any_hit[text] = True
        out[~any_hit, lexicons] = 0
        for j, pattern in enumerate(_compiled()):
            out[[bool(pattern.search(t)) for t in plain], lexicons + 1 + j] = 1
        return out


def _compiled() -> list[re.Pattern[bytes]]:
    return [re.compile(p.encode()) for p in PATTERNS]


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Texts and labels of about ``per_class`` labelled rows of each class (at most twice as many), none held out.

    A document with differing labels counts as toxic. Which rows are taken depends on the id alone.
    """
    known = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("labelled_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    known = staged(known, "labelled")
    totals = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [
        thinned(known.filter(F.col("toxic") == label), ["labelled_id"], per_class, totals.get(label, 0)).limit(
            2 * per_class
        )
        for label in (0, 1)
    ]
    # At most 4 * per_class rows of two numbers: a proven bound.
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.join(picked, docs.doc_id == picked.labelled_id)
    return rows.groupBy(F.md5("text").alias("md5")).agg(
        F.max("toxic").alias("toxic"), F.first("text").alias("text")
    )


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            for part in slices(batch, "text"):
                plain = raw(part.column("text"))
                text_of, found = features(plain)
                order = np.lexsort((found, text_of))
                text_of, found = text_of[order], found[order]
                new = np.ones(len(found), dtype=bool)
                new[1:] = (found[1:] != found[:-1]) | (text_of[1:] != text_of[:-1])
                text_of, found = text_of[new], found[new]
                ends = np.searchsorted(text_of, np.arange(len(plain) + 1)).astype(np.int32)
                shingle_of, shingles = shingle_hashes(plain)
                smallest = np.zeros(len(plain), dtype=np.uint64) + np.uint64((1 << 64) - 1)
                np.minimum.at(smallest, shingle_of, shingles)
                yield pa.RecordBatch.from_arrays([
                    part.column("md5"), part.column("toxic"), part.column("text"),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64))),
                    pa.array(smallest.view(np.int64)),
                ], names=["md5", "toxic", "text", "features", "shingle"])

    schema = "md5 string, toxic int, text string, features array<bigint>, shingle bigint"
    found = rows.select("md5", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, schema)
    # Near copies would make every word of theirs look like a mark of their class. One text is taken of
    # those that share the smallest shingle hash, as near copies do in most cases.
    first = Window.partitionBy("shingle").orderBy("md5")
    return found.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place", "shingle")


def lexicon(featured: DataFrame, least_ratio: float, size: int) -> np.ndarray:
    """Features that are at least ``least_ratio`` times as frequent in toxic texts; the most frequent ``size``."""
    totals = {row["toxic"]: row["n"] for row in featured.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return np.zeros(0, dtype=np.uint64)
    share = toxic / (toxic + clean)
    counted = featured.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    ratio = (F.col("a") / toxic) / ((F.col("b") + 0.5) / (clean + 0.5))
    # How far the toxic share of a feature's texts is from that of all, in nats: chance finds among very many
    # rare features stay out.
    a, b, n = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    evidence = a * F.log(a / (n * share)) + F.when(b > 0, b * F.log(b / (n * (1 - share)))).otherwise(0.0)
    strong = counted.filter((a > 0) & (ratio >= least_ratio) & (evidence >= LEAST_EVIDENCE))
    rows = strong.orderBy(F.desc("a"), "feature").limit(size).select("feature").collect()
    return np.sort(np.array([row["feature"] for row in rows], dtype=np.int64).view(np.uint64))


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    scorer: Linear


def _any_voter(votes: np.ndarray, groups: list[tuple[int, ...]]) -> np.ndarray:
    """A first guess: toxic is what any voter calls so."""
    return two((votes == 1).any(axis=1) * 0.8 + 0.1)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    per_class: int = SAMPLE_PER_CLASS,
    least_ratio: float = LEAST_RATIO,
    lexicon_size: int = LEXICON,
) -> Model:
    """Fit voters, label model and scorer. ``docs`` has ``doc_id`` and ``text`` without nulls in it."""
    featured = staged(_featured(sample(docs, labels, per_class)), "sample")
    voters = Voters(lexicon(featured, least_ratio, lexicon_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            for part in slices(batch, "text"):
                codes, number = np.unique(encode(voters.votes(raw(part.column("text")))), return_counts=True)
                yield pa.RecordBatch.from_pydict({"code": codes, "n": number})

    patterns = (
        docs.select("text").mapInArrow(count, "code bigint, n bigint").groupBy("code")
        .agg(F.sum("n").alias("n")).toPandas()
    )

    # The sample's rows, each with the entries of the lexicon it has.
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            for part in slices(batch, "text"):
                plain = raw(part.column("text"))
                rows = [np.array(r, dtype=np.int64).view(np.uint64) for r in part.column("features").to_pylist()]
                kept = [r[np.isin(r, voters.entries)].view(np.int64) for r in rows]
                yield pa.RecordBatch.from_pydict({
                    "toxic": part.column("toxic"), "code": encode(voters.votes(plain)), "entries": kept,
                })

    known = featured.orderBy("md5").mapInArrow(entries, "toxic int, code bigint, entries array<bigint>").toPandas()
    votes = decode(patterns["code"].to_numpy(dtype=np.int64), voters.number)
    anchors = decode(known["code"].to_numpy(dtype=np.int64), voters.number)
    label_model = fit(
        votes, patterns["n"].to_numpy(dtype=float), _any_voter,
        anchors=(anchors, known["toxic"].to_numpy()) if len(known) else None,
    )
    posterior = label_model.posterior(anchors) if len(known) else np.zeros(0)
    rows = [np.array(r, dtype=np.int64).view(np.uint64) for r in known["entries"]]
    return Model(voters, label_model, train(rows, posterior, voters.entries))


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    cut: float = CUT,
    doc_id: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` of every row of ``docs``.

    ``labels`` has ``doc_id`` and ``toxic``; rows with other labels than 0 and 1 are ignored. A null or
    empty text has no features and gets the base score. Repeated rows are scored each; a null doc_id is
    not held out. Texts are read whole. Without labelled rows every score is that of the prior.
    """
    rows = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
    scorer = learn(rows, known, **options).scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            for part in slices(batch, "text"):
                found = scorer.score(part.num_rows, *features(raw(part.column("text"))))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"), pa.array(found),
                    pa.array((found >= cut).astype(np.int32)),
                ], names=["doc_id", "held_out", "score", "predicted"])

    keyed = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return keyed.mapInArrow(run, _SCORED)


def without_toxic(
    docs: DataFrame, labels: DataFrame, *, cut: float = CUT, text: str = "text", doc_id: str = "doc_id", **options
) -> DataFrame:
    """The rows of ``docs``, all columns, whose score (see ``score``) is below ``cut``."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
    rows = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scorer = learn(rows, known, **options).scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                plain = [t or b"" for t in raw(part.column(place))]
                yield part.filter(pa.array(scorer.score(len(plain), *features(plain)) < cut))

    return docs.mapInArrow(run, docs.schema)
