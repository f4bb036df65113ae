"""Which (name, time) probes have no text event that names them within a time window.

The plain form joins every probe with every event of the window and tests the text: quadratic in a
burst. Here no probe is ever paired with an event:

1. Events are reduced to (name, time) mentions. Names are looked up by their first characters, so
   the work per text grows with its length, not with the number of names. Where the names are too
   many to broadcast, a bitmap of fixed size tells, before any shuffle, the few places where one may begin.
2. Mentions shrink, before any shuffle, to the first and last time per (case, name, time bucket).
   A bucket is as wide as the window, so these two times decide every probe exactly.
3. Probes drop out by an equality anti-join with at most three such rows each.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from gainsay.functions.time import micros

PREFIX_CHARS = 8
CHUNK_CHARS = 512
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD_BYTES = 128
# Bits of a bitmap, as a power of two, and of one word of it: at most 2**19 words, some 20 MB as a broadcast table.
BITMAP_BITS = 25
_WORD_BITS = 6


def mentions(
    events: DataFrame,
    names: DataFrame,
    *,
    keep: Sequence[str],
    text: str = "text",
    by: Sequence[str] = (),
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """``keep`` columns of each event once for every listed name found anywhere in its text.

    ``names`` has the text column ``name`` and the ``by`` columns, which ``keep`` must have too: a name is
    sought in events with equal ones only, and a null there equals nothing. Matching ignores case. A mention
    may come out more than once, and texts that merely share a listed name's beginning and length may come
    out too; both fall away when the result is aggregated and joined on the exact name.
    """
    by = list(by)
    lowered = names.select(*by, F.lower("name").alias("name")).filter(F.col("name") != "")
    index = (
        lowered.select(
            *by, F.substring("name", 1, PREFIX_CHARS).alias("prefix"), F.length("name").alias("chars")
        )
        .groupBy(*by, "prefix")
        .agg(F.collect_set("chars").alias("lengths"))
    )
    key_bytes = F.octet_length("prefix")
    for column in by:
        key_bytes = key_bytes + F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0))
    # One row comes back: how long names get and how big the index is.
    profile = index.agg(
        F.max(F.array_max("lengths")).alias("longest"),
        F.collect_set(F.length("prefix")).alias("prefix_lengths"),
        F.sum(key_bytes + 4 * F.size("lengths") + _ROW_OVERHEAD_BYTES).alias("size"),
    ).first()
    if profile["longest"] is None:
        return events.select(*keep, F.lit("").alias("name")).filter(F.lit(False))
    places = _positions(events, keep, text, profile["longest"])
    prefixes = F.array(
        *[F.col("_chunk").substr(F.col("_place"), F.lit(n)) for n in sorted(profile["prefix_lengths"])]
    )
    looked_up = places.select(
        *keep, "_chunk", "_place", F.explode(F.array_distinct(prefixes)).alias("prefix")
    )
    if profile["size"] <= broadcast_limit:
        # The text is only cut where a name begins; until then every place shares its chunk.
        return _cut(looked_up.join(F.broadcast(index), [*by, "prefix"]), keep)
    # Only places where a name may begin are shuffled, each with no more text than the longest name.
    rest = F.col("_chunk").substr(F.col("_place"), F.lit(profile["longest"]))
    hits = perhaps_in(looked_up, index, [*by, "prefix"]).select(
        *keep, rest.alias("_chunk"), F.lit(1).alias("_place"), "prefix"
    )
    return perhaps_in(_cut(hits.join(index, [*by, "prefix"]), keep), lowered, [*by, "name"])


def _cut(hits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """From places with the lengths of names that begin like the text there to the texts of these lengths."""
    return hits.select(*keep, "_chunk", "_place", F.explode("lengths").alias("chars")).select(
        *keep, F.col("_chunk").substr(F.col("_place"), F.col("chars")).alias("name")
    )


def perhaps_in(rows: DataFrame, listed: DataFrame, keys: Sequence[str], bits: int = BITMAP_BITS) -> DataFrame:
    """Rows whose ``keys`` may be among those of ``listed``: all that are, and few others. No row is shuffled.

    The keys of ``listed`` set bits by their hash in a bitmap of ``2**bits`` bits. It is broadcast as a table of
    64-bit words, of bounded size however many keys there are; the fuller it is, the more other rows pass.
    """
    slot = F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1))
    bit = slot.bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).cast("int")
    bitmap = (
        listed.select(
            F.shiftright(slot, _WORD_BITS).alias("_word"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_bit"),
        )
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_mask"))
    )
    slotted = rows.withColumn("_slot", slot)
    place = F.col("_slot").bitwiseAND(F.lit((1 << _WORD_BITS) - 1)).cast("int")
    same = (F.shiftright("_slot", _WORD_BITS) == F.col("_word")) & (
        F.call_function("bit_get", F.col("_mask"), place) == 1
    )
    return slotted.join(F.broadcast(bitmap), same).select(*rows.columns)


def _positions(events: DataFrame, keep: Sequence[str], text: str, longest: int) -> DataFrame:
    """Every position of every text, as a place in a chunk that reaches ``longest`` characters beyond it.

    Chunks overlap, so a name is whole in the chunk it begins in, and the cost is linear.
    """
    starts = F.sequence(
        F.lit(0), F.greatest(F.length("_text") - 1, F.lit(0)), F.lit(CHUNK_CHARS)
    )
    chunks = (
        events.select(*keep, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
        .select(*keep, "_text", F.explode(starts).alias("_start"))
        .select(
            *keep,
            F.col("_text")
            .substr(F.col("_start") + 1, F.lit(CHUNK_CHARS + longest - 1))
            .alias("_chunk"),
        )
        .filter(F.col("_chunk") != "")
    )
    places = F.sequence(F.lit(1), F.least(F.length("_chunk"), F.lit(CHUNK_CHARS)))
    return chunks.select(*keep, "_chunk", F.explode(places).alias("_place"))


def unmatched_in_window(
    probes: DataFrame,
    events: DataFrame,
    *,
    window: timedelta,
    name: str = "name",
    time: str = "time",
    event_text: str = "text",
    event_time: str = "time",
    by: Sequence[str] = ("case_id",),
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Probes for which no event of the same case holds the name within +-``window``, ends included.

    Repeated probes stay repeated. Probe names must not be empty.
    """
    by = list(by)
    reach = micros(window)
    width = max(reach, 1)

    candidates = events.filter(F.col(event_time).isNotNull()).select(
        *by,
        F.unix_micros(F.col(event_time)).alias("_at"),
        F.col(event_text).alias("_event_text"),
    )
    spans = (
        mentions(
            candidates,
            probes.select(*by, F.col(name).alias("name")).distinct(),
            keep=[*by, "_at"],
            text="_event_text",
            by=by,
            broadcast_limit=broadcast_limit,
        )
        .groupBy(*by, F.col("name").alias("_name"), floor_div(F.col("_at"), width).alias("_bucket"))
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        .select(
            *by,
            "_name",
            F.explode(
                F.array(F.col("_bucket") - 1, F.col("_bucket"), F.col("_bucket") + 1)
            ).alias("_bucket"),
            "_first",
            "_last",
        )
    )
    keyed = probes.withColumns(
        {
            "_name": F.lower(F.col(name)),
            "_run": F.unix_micros(F.col(time)),
        }
    ).withColumn("_bucket", floor_div(F.col("_run"), width))
    left, right = keyed.alias("l"), spans.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*by, "_name", "_bucket")]
    overlap = [
        F.col("r._last") >= F.col("l._run") - reach,
        F.col("r._first") <= F.col("l._run") + reach,
    ]
    condition = same[0]
    for part in (*same[1:], *overlap):
        condition = condition & part
    return left.join(right, condition, "left_anti").drop("_name", "_run", "_bucket")


def floor_div(value: Column, width: int) -> Column:
    """Floor division that also holds before 1970."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))
