"""Playback sessions over a stream of start and stop events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelwright.constants import PLAYBACK_START, PLAYBACK_STOP
from reelwright.operators.grouping import spread_join
from reelwright.operators.playback import playback_sessions
from reelwright.streaming.waiting import ONCE, Emit, run_waiting

HOLD_SECONDS = 30 * 86400
EVENTS = "event_id bigint, type string, ts timestamp, user_id string, item_id string, name string"


def mark_paired(events: DataFrame, clock: Column, hold_seconds: int = HOLD_SECONDS) -> DataFrame:
    """Events with ``settled``: no later event can change the session they belong to.

    That is so up to the last stop of the user and item that the clock has passed, as no earlier
    event is still to come. A start that met no stop for ``hold_seconds`` is settled too.
    """
    key = ["user_id", "item_id"]
    place = F.struct("ts", "event_id")
    timed = events.withColumn("passed", F.col("ts") <= clock)
    stops = timed.where((F.col("type") == PLAYBACK_STOP) & F.col("passed"))
    last = stops.groupBy(*key).agg(F.max(place).alias("last_stop"))
    before = F.coalesce(place <= F.col("last_stop"), F.lit(False))
    expired = F.col("ts") + F.expr(f"INTERVAL {hold_seconds} SECONDS") <= clock
    joined = spread_join(timed, last, key, "left")
    return joined.withColumn("settled", before | expired).drop("passed", "last_stop")


def run_sessions(events: DataFrame, state_dir: str, checkpoint: str, emit: Emit, late_seconds: int = 600,
                 hold_seconds: int = HOLD_SECONDS, trigger: Mapping[str, object] = ONCE) -> StreamingQuery:
    """Start the pairing over a stream of events; ``emit`` gets the sessions that became final.

    Settled events are paired by ``playback_sessions``, so the stream gives what the batch operator
    gives, in whatever micro-batches the events come, as long as none is later than ``late_seconds``
    and no stop comes more than ``hold_seconds`` after its start.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        rows = batch.where(F.col("type").isin(PLAYBACK_START, PLAYBACK_STOP) & F.col("ts").isNotNull())
        return rows.select("event_id", "type", "ts", F.coalesce("user_id", F.lit("")).alias("user_id"),
                           F.coalesce("item_id", F.lit("")).alias("item_id"), "name")

    def pair(settled: DataFrame, batch_id: int) -> None:
        emit(playback_sessions(settled), batch_id)

    # A stop settles its key's rows once the clock has passed it, a start at the latest when it has been held long enough.
    held = F.col("ts") + F.expr(f"INTERVAL {hold_seconds} SECONDS")
    due = F.when(F.col("type") == PLAYBACK_STOP, F.col("ts")).otherwise(held)
    return run_waiting(events, prepare, EVENTS, lambda rows, clock: mark_paired(rows, clock, hold_seconds), pair,
                       state_dir, checkpoint, late_seconds, trigger, key=["user_id", "item_id"], due=due)
