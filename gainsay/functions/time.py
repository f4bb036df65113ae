"""Time expressions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, functions as F

# Microseconds from 1601-01-01 to 1970-01-01, and the last FILETIME tick of year 9999.
EPOCH_OFFSET_MICROS = 11_644_473_600_000_000
LAST_FILETIME = 2_650_467_743_999_999_999


def micros(delta: timedelta) -> int:
    return delta // timedelta(microseconds=1)


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def utc(timestamp: Column) -> Column:
    """Normalise to an instant: zone-less values are taken as UTC, whatever the session's time zone."""
    since_epoch = (timestamp - F.expr(_EPOCH)).cast("interval second").cast("decimal(20,6)")
    zone_less = F.timestamp_micros((since_epoch * 1_000_000).cast("bigint"))
    # The type is known when the plan is made, so only one branch is left in it.
    return F.when(F.typeof(timestamp) == "timestamp_ntz", zone_less).otherwise(
        timestamp.try_cast("timestamp")
    )


def utc_text(timestamp: Column) -> Column:
    """The instant's date and time in UTC as text, without a fraction, whatever the session's time zone."""
    seconds = F.unix_micros(timestamp).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    zero = F.lit(0)
    shifted = F.expr(_EPOCH) + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    whole = F.regexp_extract(shifted.cast("string"), r"^[^.]+", 0)
    return F.when(timestamp.isNotNull(), F.replace(whole, F.lit(" "), F.lit("T")))


def filetime_to_timestamp(ticks: Column) -> Column:
    """100 ns ticks since 1601 to a timestamp; 0 means not set, later than year 9999 is unusable."""
    usable = (ticks > 0) & (ticks <= LAST_FILETIME)
    since_1970 = F.call_function("div", ticks, F.lit(10)) - F.lit(EPOCH_OFFSET_MICROS)
    return F.when(usable, F.timestamp_micros(since_1970.cast("bigint")))


def timestamp_to_filetime(timestamp: Column) -> Column:
    return (F.unix_micros(timestamp) + F.lit(EPOCH_OFFSET_MICROS)) * F.lit(10)
