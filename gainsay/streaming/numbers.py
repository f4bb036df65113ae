"""Gaps in the record numbers of logs that are still being written.

A stateful operator keeps, per source and range of numbers, the islands: runs of numbers without a gap. It
gives out what changes: an island that is new (+1) and one that is no more (-1), because a number made it
longer or joined it with another. Repeated numbers change nothing, late ones fill their gap, in any
order of arrival. What holds now is the sum of the changes, and the gaps lie between the islands.

Sources are dealt to groups by their hash, and a state holds one range of the numbers of one group, so a call has
many sources to work on at once. A log of any size has as many states as ranges; with very many sources whose
numbers lie in one range, raise ``groups``. The operator needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from gainsay.operators.gaps import between_islands

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RANGE_BITS = 16
GROUPS = 256
# Sources lie one behind the other on a line, each with room for its range and as much between it and the next.
_LINE_BITS = RANGE_BITS + 1
_IN_RANGE = (1 << RANGE_BITS) - 1

_STATE = StructType([
    StructField("sources", ArrayType(StringType())), StructField("first", BinaryType()), StructField("last", BinaryType())
])
_CHANGES = StructType([StructField("_source", StringType()), *[StructField(c, LongType()) for c in ("first", "last", "change")]])
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def merged(first: np.ndarray, last: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Islands of what lies in rising islands or is one of the numbers."""
    starts, ends = np.concatenate([first, numbers]), np.concatenate([last, numbers])
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], starts[1:] > ends[:-1] + 1])
    return starts[opens], ends[np.append(np.flatnonzero(opens)[1:] - 1, len(ends) - 1)]


class Islands(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("islands", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sources, before = [], (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        if self._state.exists():
            held = self._state.get()
            sources, before = list(held[0]), tuple(np.frombuffer(bytes(side), dtype=np.int64) for side in held[1:])
        places = {source: place for place, source in enumerate(sources)}
        after = before
        for batch in rows:
            # By place: names with a leading underscore do not arrive as they are.
            codes, named = pd.factorize(batch.iloc[:, 0])
            lines = np.array([places.setdefault(source, len(places)) for source in named], dtype=np.int64) << _LINE_BITS
            numbers = batch.iloc[:, 1].to_numpy(dtype=np.int64)
            after = merged(*after, np.unique(lines[codes] + (numbers & _IN_RANGE)))
        sources = np.array(list(places), dtype=object)
        self._state.update((sources.tolist(), after[0].tobytes(), after[1].tobytes()))
        # Both ends of an island in one number; the end lies in the range of the beginning.
        old, new = (first << RANGE_BITS | last & _IN_RANGE for first, last in (before, after))
        lost, won = np.setdiff1d(old, new, assume_unique=True), np.setdiff1d(new, old, assume_unique=True)
        if len(lost) or len(won):
            pairs = np.concatenate([lost, won])
            start = np.int64(key[1]) << RANGE_BITS
            yield pd.DataFrame({
                "_source": sources[pairs >> (RANGE_BITS + _LINE_BITS)],
                "first": start + (pairs >> RANGE_BITS & _IN_RANGE),
                "last": start + (pairs & _IN_RANGE),
                "change": np.repeat(np.array([-1, 1], dtype=np.int64), [len(lost), len(won)]),
            })

    def close(self) -> None:
        pass


def island_changes(
    records: DataFrame, *, by: Sequence[str], number: str = "record_number", groups: int = GROUPS
) -> DataFrame:
    """Changes of the islands of a stream of records: ``by``, ``first``, ``last`` and ``change`` (1 or -1).

    Null numbers are left out. Sources are dealt to ``groups``, which must stay the same over restarts. Meant for an
    append sink; ``current_gaps`` reads that.
    """
    by = list(by)
    value = F.col(number).cast("bigint")
    key = StructType([records.schema[name] for name in by])
    source = F.struct(*by)
    numbers = records.filter(value.isNotNull()).select(
        F.to_json(source, _EXACT).alias("_source"),
        value.alias("_number"),
        F.pmod(F.xxhash64(*by), F.lit(groups)).alias("_group"),
        F.shiftright(value, RANGE_BITS).alias("_range"),
    )
    changes = numbers.groupBy("_group", "_range").transformWithStateInPandas(Islands(), _CHANGES, "Append", "None")
    own = F.from_json("_source", key, _EXACT).alias("_by")
    return changes.select(own, "first", "last", "change").select(
        *[F.col("_by")[name].alias(name) for name in by], "first", "last", "change"
    )


def current_gaps(changes: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """The gaps that hold after all changes, like those of ``record_gaps`` over the same records."""
    by = list(by)
    held = changes.groupBy(*by, "first", "last").agg(F.sum("change").alias("_held")).filter("_held > 0")
    return between_islands(held.drop("_held"), by=by)
