"""Batches of queued ids that close after a quiet time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.constants import QUIET_SECONDS
from reelwright.operators.grouping import attach_group_values, spread_join


RANGE_SLOTS = 4096


def quiet_batches(events: DataFrame, quiet_seconds: int = QUIET_SECONDS) -> DataFrame:
    """Events with ``batch_start`` and ``batch_end`` of their batch; a batch ends in quiet time.

    Two events in one slot of the quiet time's length always share a batch, so only the first
    and last moment of each slot need ordering. Slots are ordered within ranges of
    ``RANGE_SLOTS`` slots; what a range takes over from the ones before it, its last moment and
    the batch that is open, is carried across the ranges, of which there is one row each.
    """
    quiet = quiet_seconds * 1_000_000
    rows = events.withColumn("slot", F.floor(F.unix_micros("ts") / quiet))
    slots = rows.groupBy("slot").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn(
        "range", F.floor(F.col("slot") / RANGE_SLOTS))
    inside, across = Window.partitionBy("range").orderBy("slot"), Window.orderBy("range")
    until_row = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier_ranges = across.rowsBetween(Window.unboundedPreceding, -1)

    def apart(first: str, last: Column) -> Column:
        return F.unix_micros(first) - F.unix_micros(last) >= quiet

    # Null in the first slot of a range, which only the ranges before it can place.
    opened = slots.withColumn("opens", F.when(apart("first_ts", F.lag("last_ts").over(inside)), F.col("first_ts")))
    ranges = opened.groupBy("range").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("opens").alias("opens"))
    before = F.lag("last_ts").over(across)
    ranges = ranges.withColumn("first_opens", F.when(before.isNull() | apart("first_ts", before), F.col("first_ts")))
    open_before = F.last(F.coalesce("opens", "first_opens"), True).over(earlier_ranges)
    ranges = ranges.select("range", F.coalesce("first_opens", open_before).alias("open_at_start"))
    numbered = opened.join(ranges, "range").select(
        "slot", "last_ts", F.coalesce(F.last("opens", True).over(until_row), F.col("open_at_start")).alias("batch_start"))
    ended = attach_group_values(numbered, ["batch_start"], batch_end=F.max("last_ts"))
    return spread_join(rows, ended.select("slot", "batch_start", "batch_end"), "slot").drop("slot")


def debounce_batches(routed: DataFrame, quiet_seconds: int = QUIET_SECONDS) -> DataFrame:
    """(batch_start, batch_end, queue, id, name): each id once per batch, its last name."""
    rows = quiet_batches(routed, quiet_seconds)
    last = F.max(F.struct("ts", "event_id", "name"))
    return rows.groupBy("batch_start", "batch_end", "queue", "id").agg(
        last["name"].alias("name"), F.count("*").alias("n_events"))
