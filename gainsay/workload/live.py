"""Queries that replay whole tables as streams and end where the batch rules do."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsay.session import use_checkpoint_dir
from gainsay.streaming.numbers import STORE, current_gaps, island_changes
from gainsay.streaming.presence import live_unmatched
from gainsay.workload import standins
from gainsay.workload.catalog import USER_GAPS_SQL, query

SLICES = 3
WINDOW = timedelta(hours=6)


def replayed(
    spark: SparkSession, arrivals: Iterable[dict[str, DataFrame]], plan: Callable[[dict[str, DataFrame]], DataFrame]
) -> DataFrame:
    """What a streaming plan has given out when all arrivals are through.

    Each arrival adds rows to the plan's named inputs. The query is then started, runs until it has read them, and
    stops: the next start goes on from its checkpoint, as after a loss of the driver. All files are in the shared
    folder. The state store is set in a session of its own.
    """
    folder = f"{use_checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for arrived in arrivals:
        for name, rows in arrived.items():
            rows.write.mode("append").parquet(f"{folder}/in/{name}")
        inputs = {
            name: session.readStream.schema(rows.schema).parquet(f"{folder}/in/{name}") for name, rows in arrived.items()
        }
        running = (
            plan(inputs).writeStream.format("parquet").option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(USER_GAPS_SQL)
def live_record_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in slices without any order; every slice repeats a tenth of the one before."""
    events = standins.read(spark, sf_dir, "events").select("user_id", "event_id")
    place = F.pmod(F.xxhash64("event_id"), F.lit(10 * SLICES))
    arrivals = [{"events": events.filter((place >= 10 * i - 1) & (place < 10 * (i + 1)))} for i in range(SLICES)]
    changes = replayed(
        spark, arrivals, lambda inputs: island_changes(inputs["events"], by=["user_id"], number="event_id")
    )
    return current_gaps(changes, by=["user_id"])


@query("""
SELECT p.event_id FROM events p
WHERE p.event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM events e
  WHERE e.event_type IN ('click', 'view') AND e.user_id % 4 = p.user_id % 4
    AND e.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR
    AND contains(lower(e.props), '"k": ' || (p.user_id % 100) || '}'))
""")
def live_execution_without_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and views as they come in, a slice of time after the other; a later tick ends the last windows."""
    rows = standins.read(spark, sf_dir, "events").withColumn("time", standins.utc(F.col("ts")))
    case_id = standins.case_of("user_id").alias("case_id")
    name = F.concat(F.lit('"K": '), (F.col("user_id") % 100).cast("string"), F.lit("}")).alias("name")
    runs = rows.filter("event_type = 'purchase'").select(case_id, name, "time", "event_id")
    events = rows.filter("event_type IN ('click', 'view')").select(case_id, F.col("props").alias("text"), "time")
    first, last = rows.agg(F.min(F.unix_micros("time")), F.max(F.unix_micros("time"))).first()
    ends = [first + (last - first) * (i + 1) // SLICES for i in range(SLICES - 1)] + [last]

    def slice_of(df: DataFrame, i: int) -> DataFrame:
        at = F.unix_micros("time")
        return df.filter((at > ends[i - 1] if i else at >= first) & (at <= ends[i]))

    # The tick must pass the filters of the plan, or it moves no watermark; its own window never ends.
    word = F.lit("tick")
    tick = F.timestamp_micros(F.lit(last + 10 * 86_400_000_000)).alias("time")
    one = spark.range(1)
    arrivals = [{"runs": slice_of(runs, i), "events": slice_of(events, i)} for i in range(SLICES)]
    arrivals.append({
        "runs": one.select(word.alias("case_id"), word.alias("name"), tick, F.lit(-1).cast("bigint").alias("event_id")),
        "events": one.select(word.alias("case_id"), word.alias("text"), tick),
    })
    names = runs.select("name").union(one.select(word)).distinct()
    found = replayed(
        spark, arrivals,
        lambda inputs: live_unmatched(inputs["runs"], inputs["events"], names, window=WINDOW, late=timedelta(minutes=1)),
    )
    return found.select("event_id")
