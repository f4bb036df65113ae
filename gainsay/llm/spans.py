"""Spans in texts: kind, start and end in code points, and their digests."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence
from itertools import accumulate

from pyspark.sql import Column, functions as F

# kind, start, end, whether it is one of the fixed kinds' own matches
Span = tuple[str, int, int, bool]

SPANS = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean"


class Covered:
    """What some (start, end) pairs of a text cover, as disjoint rising ranges."""

    def __init__(self, pairs: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(pairs):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        """Whether a non-empty range overlaps any pair."""
        place = bisect_left(self.starts, end)
        return place > 0 and self.ends[place - 1] > start

    def add(self, start: int, end: int) -> None:
        """One more range, which touches none."""
        place = bisect_right(self.starts, start)
        self.starts.insert(place, start)
        self.ends.insert(place, end)


class Holding:
    """Finds out whether a range lies within one of some (start, end) pairs."""

    def __init__(self, pairs: Iterable[tuple[int, int]]):
        ordered = sorted(pairs)
        self.starts = [start for start, _ in ordered]
        self.furthest = list(accumulate((end for _, end in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        place = bisect_right(self.starts, start)
        return place > 0 and self.furthest[place - 1] >= end


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """``kind:start:end`` of all spans, comma-joined, by start and then in the order of ``kinds``, others after."""
    place = F.create_map(*[x for i, kind in enumerate(kinds) for x in (F.lit(kind), F.lit(i))])

    def key(s: Column) -> Column:
        order = F.coalesce(place[s["kind"]], F.lit(len(kinds)))
        return F.struct(s["start"].alias("a"), order.alias("b"), s["kind"].alias("c"), s["end"].alias("d"))

    ordered = F.array_sort(F.transform(spans, key))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["c"], s["a"].cast("string"), s["d"].cast("string"))),
        ",",
    )


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def count(spans: Column, kind: str) -> Column:
    """Number of the fixed kind's own matches."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
