"""Places in an order over all rows, without a window over all rows.

Rows are dealt to parts by ranges of their order and written once, sorted, to the checkpoint folder; the number of parts
grows with the rows, which are counted first, so a part has a bounded size. What a
row needs from the rows before it comes from a window over its own part and from the part's border: one
row per part, carried from part to part. Rows that are equal in the whole order are spread over parts too,
so neither a hot key nor a burst at one time makes a part large.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from gainsay.functions.time import micros
from gainsay.session import checkpointed

PART, PLACE = "_part", "_place"
_PLACE_BITS = 33
PART_ROWS = 1 << 18


def _in_part() -> WindowSpec:
    return Window.partitionBy(PART).orderBy(PLACE)


def _over_parts() -> WindowSpec:
    """Over the borders only: one row per part."""
    return Window.orderBy(PART)


def _earlier_parts() -> WindowSpec:
    return _over_parts().rowsBetween(Window.unboundedPreceding, -1)


def parts_of(rows: DataFrame) -> int:
    """How many parts ``rows`` should be dealt to: one for ``PART_ROWS``. Counts them, without their columns."""
    return -(-rows.agg(F.count(F.lit(1))).first()[0] // PART_ROWS)


def by_range(rows: DataFrame, keys: Sequence[Column | str], parts: int) -> DataFrame:
    """``rows`` dealt by ranges of ``keys`` to as many partitions, or to the session's where that is more."""
    if parts <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartitionByRange(*keys)
    return rows.repartitionByRange(parts, *keys)


def sorted_in_parts(rows: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Like ``orderBy``, but no task sorts much more than ``PART_ROWS``. ``rows`` are read three times, so write them before."""
    return by_range(rows, keys, parts_of(rows)).sortWithinPartitions(*keys)


def in_parts(rows: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """``rows`` in the order of ``keys``, with the number of the part and the place in it, from 0.

    Parts are numbered in the order of the keys. The result is written, so numbers hold for all later reads.
    """
    tie = F.monotonically_increasing_id()
    spread = rows.withColumn("_tie", tie)
    ordered = by_range(spread, [*keys, "_tie"], parts_of(rows)).sortWithinPartitions(*keys, "_tie").drop("_tie")
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id()).withColumns({
        PART: F.shiftright("_id", _PLACE_BITS).cast("int"),
        PLACE: F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
    })
    return checkpointed(numbered.drop("_id"))


def by_part(ordered: DataFrame) -> DataFrame:
    """What ``in_parts`` gave, for windows over parts: few parts a task however many there are."""
    parts = ordered.rdd.getNumPartitions()
    if parts <= int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return ordered
    return ordered.repartitionById(parts, PART)


def numbered(rows: DataFrame, keys: Sequence[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their position in the order of ``keys``, from 1. Rows equal in all keys come in any order."""
    ordered = in_parts(rows, keys)
    parts = ordered.groupBy(PART).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(_earlier_parts()), F.lit(0))
    return (
        ordered.join(F.broadcast(parts.select(PART, before.alias("_before"))), PART)
        .withColumn(name, F.col("_before") + F.col(PLACE) + 1)
        .drop(PART, PLACE, "_before")
    )


def in_sessions(
    rows: DataFrame,
    *,
    by: Sequence[str],
    time: str,
    idle: timedelta,
    then: Sequence[Column | str] = (),
    position: str = "position",
    session: str = "session",
) -> DataFrame:
    """``rows`` in the order of ``by``, ``time`` and ``then``, with their position and session, both from 1.

    A session ends where the next row has other ``by`` columns or comes more than ``idle`` later. Sessions
    are numbered over all rows. Null ``by`` columns are equal to each other; a row without a time has
    neither a position nor a session and is left out.
    """
    entry = F.struct(F.struct(*by).alias("key"), F.unix_micros(time).alias("at"))
    ordered = by_part(in_parts(rows.filter(F.col(time).isNotNull()), [*by, time, *then])).withColumn("_entry", entry)

    def starts(before: Column) -> Column:
        other = ~before["key"].eqNullSafe(F.col("_entry.key"))
        return before.isNull() | other | (F.col("_entry.at") - before["at"] > micros(idle))

    # The first row of a part is compared with the last one of the part before it.
    inside = F.when(F.col(PLACE) > 0, starts(F.lag("_entry").over(_in_part())).cast("bigint")).otherwise(F.lit(0))
    counted = ordered.withColumn("_inside", inside).withColumn("_inside", F.sum("_inside").over(_in_part()))
    borders = counted.groupBy(PART).agg(
        F.min_by("_entry", PLACE).alias("_entry"),
        F.max_by("_entry", PLACE).alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
        F.max("_inside").alias("_starts"),
    )
    opens = borders.withColumn("_opens", starts(F.lag("_last").over(_over_parts())).cast("bigint"))
    earlier = lambda c: F.coalesce(F.sum(c).over(_earlier_parts()), F.lit(0))
    carried = opens.select(
        PART, earlier("_rows").alias("_before"), (earlier(F.col("_starts") + F.col("_opens")) + F.col("_opens")).alias("_earlier")
    )
    return (
        counted.join(F.broadcast(carried), PART)
        .withColumns({
            position: F.col("_before") + F.col(PLACE) + 1,
            session: F.col("_earlier") + F.col("_inside"),
        })
        .drop(PART, PLACE, "_entry", "_inside", "_before", "_earlier")
    )


def nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    name: str = "nearest",
    before: bool = True,
    after: bool = True,
    within: timedelta | None = None,
) -> DataFrame:
    """``left`` with the row of ``right`` that is nearest in time among those with the same ``by`` columns.

    ``name`` is a struct of ``at``, ``micros`` (how much later it is, negative if earlier) and the ``take``
    columns; null where there is no such row, and for left rows with a null time or a null in ``by``. Of equal
    distances the earlier time wins; of rows at one time the smallest by ``take``, which must be orderable.
    ``before`` and ``after`` say which sides count (an equal time counts for both), ``within`` how far.

    Both sides are sorted as one. A left row takes the last right row before it and the first after it in its
    part; where its part has none, those of the nearest part that has one. Right rows of one key and time are
    one before the shuffle, and a key may reach over any number of parts.
    """
    by = list(by)
    at = F.unix_micros(F.col(right_time))
    rights = (
        right.filter(F.col(right_time).isNotNull())
        .groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], at.alias("_at"))
        .agg(F.min(F.struct(*take)).alias("_take"))
        .withColumn("_side", F.lit(0))
    )
    lefts = left.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)],
        F.unix_micros(F.col(left_time)).alias("_at"),
        F.struct(*left.columns).alias("_left"),
        F.lit(1).alias("_side"),
    )
    keys = [f"_by{i}" for i in range(len(by))]
    both = rights.unionByName(lefts, allowMissingColumns=True)
    placed = in_parts(both, [*keys, "_at", "_side"]).withColumn(
        "_entry", F.when(F.col("_side") == 0, F.struct(F.struct(*keys).alias("key"), F.col("_at").alias("at"), F.col("_take").alias("take")))
    )
    place = F.when(F.col("_side") == 0, F.col(PLACE))
    borders = placed.groupBy(PART).agg(F.min_by("_entry", place).alias("_first"), F.max_by("_entry", place).alias("_last"))
    carried = borders.select(
        PART,
        F.last("_last", ignorenulls=True).over(_earlier_parts()).alias("_carried_before"),
        F.last("_first", ignorenulls=True).over(Window.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)).alias("_carried_after"),
    )
    to_here = _in_part().rowsBetween(Window.unboundedPreceding, 0)
    # Backwards: a frame up to the last row would be gone through again for every row.
    from_here = Window.partitionBy(PART).orderBy(F.desc(PLACE)).rowsBetween(Window.unboundedPreceding, 0)
    found = (
        by_part(placed).withColumns({
            "_before": F.last("_entry", ignorenulls=True).over(to_here),
            "_after": F.last("_entry", ignorenulls=True).over(from_here),
        })
        .filter("_side = 1")
        .join(F.broadcast(carried), PART)
    )

    def usable(entry: Column, wanted: bool) -> Column:
        same = F.lit(wanted) & (entry["key"] == F.struct(*keys)) & F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x)
        apart = entry["at"] - F.col("_at")
        near = same & apart.isNotNull() if within is None else same & (F.abs(apart) <= micros(within))
        return F.when(near, F.struct(F.abs(apart).alias("far"), apart.alias("micros"), entry["at"].alias("at"), entry["take"].alias("take")))

    earlier = F.coalesce("_before", "_carried_before")
    # A right row at the very time sorts before the left one and is as near from either side.
    own = F.when(earlier["at"] == F.col("_at"), earlier)
    later = F.when(own["key"] == F.struct(*keys), own).otherwise(F.coalesce("_after", "_carried_after"))
    # The distance comes first in the struct, then the sign: the nearest, and of two the earlier one.
    best = F.least(usable(earlier, before), usable(later, after))
    shown = F.struct(
        F.timestamp_micros(best["at"]).alias("at"), best["micros"].alias("micros"), *[best["take"][c].alias(c) for c in take]
    )
    return found.select("_left.*", F.when(best.isNotNull(), shown).alias(name))
