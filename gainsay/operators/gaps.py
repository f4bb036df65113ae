"""Gaps in number sequences, one sequence per source.

Numbers are first packed 64 to a word with a bit-or, which combines before the shuffle: repeats
vanish and a dense log shrinks up to 64 times, however large one source is. Neighbouring words are
then compared in windows over fixed number ranges, so no window ever holds a whole source. A range
leaves one row, its first and last number, and these rows are compared among each other in a window
per source: one row per 2**26 numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gainsay.operators.order import PART, PLACE, in_parts

_WORD_BITS = 6
_RANGE_BITS = 20


def record_gaps(
    records: DataFrame, *, by: Sequence[str], number: str = "record_number"
) -> DataFrame:
    """One row per gap: ``by``, the numbers before and after it, and how many are missing between."""
    by = list(by)
    value = F.col(number).cast("bigint")
    bit = value.bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).cast("int")
    words = (
        records.filter(value.isNotNull())
        .select(
            *by,
            F.shiftright(value, _WORD_BITS).alias("_unit"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit"),
        )
        .groupBy(*by, "_unit")
        .agg(F.bit_or("_bit").alias("_mask"))
        .withColumns({"_first": _nth_number("_unit", "_mask", True), "_last": _nth_number("_unit", "_mask", False)})
        .withColumn("_range", F.shiftright("_unit", _RANGE_BITS))
    )
    order = Window.partitionBy(*by, "_range").orderBy("_unit")
    compared = words.withColumns(
        {"_next": F.lead("_first").over(order), "_head": F.first("_first").over(order)}
    )
    # What a word has to say: gaps inside it, the gap after it, and for the last of a range the range's ends.
    pair = "array<struct<_end:boolean,previous:bigint,current:bigint>>"
    inside = F.when(F.col("_last") - F.col("_first") >= F.bit_count("_mask"), _inside_word())
    after = F.when(F.col("_next") - F.col("_last") > 1, F.array(_pair(False, F.col("_last"), F.col("_next"))))
    ends = F.when(F.col("_next").isNull(), F.array(_pair(True, F.col("_head"), F.col("_last"))))
    none = F.array().cast(pair)
    said = compared.select(
        *by, F.explode(F.concat(*[F.coalesce(x.cast(pair), none) for x in (inside, after, ends)])).alias("_said")
    ).select(*by, "_said.*")
    between = Window.partitionBy(*by).orderBy("previous")
    ranges = (
        said.filter("_end")
        .select(*by, F.col("current").alias("previous"), F.lead("previous").over(between).alias("current"))
        .filter(F.col("current") - F.col("previous") > 1)
    )
    missing = F.col("current") - F.col("previous") - 1
    return said.filter("NOT _end").drop("_end").unionByName(ranges).withColumn("missing", missing)


def _pair(end: bool, previous: Column, current: Column) -> Column:
    return F.struct(F.lit(end).alias("_end"), previous.alias("previous"), current.alias("current"))


def _nth_number(unit: str, mask: str, lowest: bool) -> Column:
    """The lowest or highest number of a word, by the place of that bit in the mask."""
    value = F.col(mask)
    # Bits beyond the wanted one are filled, so that their number is its place. No step can overflow.
    for shift in (1, 2, 4, 8, 16, 32):
        filled = F.shiftleft(value, shift) if lowest else F.shiftrightunsigned(value, shift)
        value = value.bitwiseOR(filled)
    place = F.lit(1 << _WORD_BITS) - F.bit_count(value) if lowest else F.bit_count(value) - 1
    return F.shiftleft(unit, _WORD_BITS) + place


def _inside_word() -> Column:
    """Gaps between two numbers of the same word; most words of a dense log have none."""
    places = F.sequence(F.lit(0), F.lit((1 << _WORD_BITS) - 1))
    bits = F.filter(places, lambda place: F.call_function("bit_get", F.col("_mask"), place) == 1)
    start = F.shiftleft("_unit", _WORD_BITS)
    pairs = F.zip_with(
        F.slice(bits, F.lit(1), F.size(bits) - 1),
        F.slice(bits, F.lit(2), F.size(bits) - 1),
        lambda a, b: _pair(False, start + a, start + b),
    )
    return F.filter(pairs, lambda p: p["current"] - p["previous"] > 1)


def significant(gaps: DataFrame, threshold: int = 10) -> DataFrame:
    return gaps.filter(F.col("missing") >= threshold)


def minor(gaps: DataFrame, threshold: int = 10) -> DataFrame:
    return gaps.filter(F.col("missing") < threshold)


def summarise(gaps: DataFrame, by: Sequence[str]) -> DataFrame:
    return gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("gap_count"),
        F.sum("missing").alias("total_missing"),
        F.max("missing").alias("largest"),
    )


def first_gaps(gaps: DataFrame, by: Sequence[str], limit: int = 10) -> DataFrame:
    """The first ``limit`` gaps of each source. Each task keeps at most that many before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("previous"))
    return gaps.withColumn("place", place).filter(F.col("place") <= limit)


def between_islands(islands: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """The gaps between runs of numbers (``by``, ``first``, ``last``) that do not overlap.

    The runs are sorted as one; the last run of a part is carried to the next, so a source may have any number.
    """
    by = list(by)
    entry = F.struct(F.struct(*by).alias("key"), F.col("last").alias("last"))
    ordered = in_parts(islands, [*by, "first"]).withColumn("_entry", entry)
    borders = ordered.groupBy(PART).agg(F.max_by("_entry", PLACE).alias("_end"))
    carried = borders.select(PART, F.lag("_end").over(Window.orderBy(PART)).alias("_carried"))
    before = F.coalesce(F.lag("_entry").over(Window.partitionBy(PART).orderBy(PLACE)), F.col("_carried"))
    missing = F.col("current") - F.col("previous") - 1
    return (
        ordered.join(F.broadcast(carried), PART)
        .withColumn("_before", before)
        .filter(F.col("_before.key").eqNullSafe(F.col("_entry.key")) & (F.col("first") - F.col("_before.last") > 1))
        .select(*by, F.col("_before.last").alias("previous"), F.col("first").alias("current"))
        .withColumn("missing", missing)
    )
