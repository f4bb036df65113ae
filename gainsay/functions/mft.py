"""File-record expressions: name choice and timestamp comparison."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, functions as F

from gainsay.functions.time import micros

TIME_FIELDS = ("creation_time", "modification_time", "mft_modification_time", "access_time")

# Fixed value: file name namespaces, most preferred first. Unknown ones rank last.
NAMESPACE_ORDER = (1, 3, 0, 2)

TOLERANCE = timedelta(seconds=1)


def namespace_rank(namespace: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(n) for n in NAMESPACE_ORDER]), namespace.cast("int"))
    return F.when(place > 0, place.cast("int") - 1).otherwise(len(NAMESPACE_ORDER))


def preferred_name(names: Column) -> Column:
    """The entry with the best namespace; the first one among equals."""
    ranked = F.transform(
        names,
        lambda name, place: F.struct(
            namespace_rank(name["namespace"]).alias("rank"), place.alias("place"), name.alias("name")
        ),
    )
    return F.array_min(ranked)["name"]


def timestamp_anomalies(
    standard: dict[str, Column], created: Column, tolerance: timedelta = TOLERANCE
) -> Column:
    """Names of the standard times that lie before ``created`` by more than ``tolerance``."""
    earliest = F.unix_micros(created) - F.lit(micros(tolerance))
    return F.array_compact(
        F.array(
            *[
                F.when(F.unix_micros(value) < earliest, F.lit(field))
                for field, value in standard.items()
            ]
        )
    )


def record_anomalies(standard: Column, file_name: Column, tolerance: timedelta = TOLERANCE) -> Column:
    return timestamp_anomalies(
        {field: standard[field] for field in TIME_FIELDS}, file_name["creation_time"], tolerance
    )
