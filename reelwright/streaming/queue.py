"""Debounced queue as a table: events wait in files until their batch has gone quiet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelwright.constants import QUIET_SECONDS
from reelwright.operators import genres, localize
from reelwright.operators.debounce import debounce_batches, quiet_batches
from reelwright.sources.events import item_added, parse_events, route_events
from reelwright.streaming.waiting import ONCE, Emit, run_waiting

QUEUED = "ts timestamp, event_id bigint, queue string, id string, name string"


def mark_closed(events: DataFrame, clock: Column, quiet_seconds: int = QUIET_SECONDS) -> DataFrame:
    """Events with ``settled``: their batch has gone quiet by the clock."""
    quiet_until = F.col("batch_end") + F.expr(f"INTERVAL {quiet_seconds} SECONDS")
    return quiet_batches(events, quiet_seconds).withColumn("settled", quiet_until <= clock)


def run_queue(bodies: DataFrame, state_dir: str, checkpoint: str, flush: Emit, late_seconds: int = 600,
              quiet_seconds: int = QUIET_SECONDS, trigger: Mapping[str, object] = ONCE) -> StreamingQuery:
    """Start the queue over a stream of event bodies; ``flush`` gets each closed set of batches.

    The last batch closes with the first event or tick (``waiting.with_ticks``) after its quiet time.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        routed = route_events(item_added(parse_events(batch.where("ts IS NOT NULL"))))
        return routed.select("ts", "event_id", "queue", "id", "name")

    def close(settled: DataFrame, batch_id: int) -> None:
        flush(debounce_batches(settled, quiet_seconds), batch_id)

    return run_waiting(bodies, prepare, QUEUED, lambda rows, clock: mark_closed(rows, clock, quiet_seconds), close,
                       state_dir, checkpoint, late_seconds, trigger)


def flush_to_tables(items: DataFrame, genre_snapshot: DataFrame, localized: DataFrame, out_dir: str) -> Emit:
    """Flush that runs the genre pass and then the description pass on the batch's ids."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        def ids(queue: str) -> DataFrame:
            return batch.where(F.col("queue") == queue).select(F.col("id").alias("item_id")).distinct()

        fixed = genres.process_genres(items, genre_snapshot, ids("genres"))
        fixed.where("status = 'updated'").select("item_id", "new_genres").write.mode("overwrite").parquet(
            f"{out_dir}/genres/batch={batch_id}")
        asked = items.join(ids("descriptions"), "item_id", "left_semi")
        proposed = localize.propose_updates(asked, items, localized)
        localize.apply_metadata_patch(proposed).write.mode("overwrite").parquet(f"{out_dir}/descriptions/batch={batch_id}")

    return flush


def session_summary(routed: DataFrame, tenant: str, late: str = "10 minutes", quiet_seconds: int = QUIET_SECONDS) -> DataFrame:
    """Streaming counts per tenant and quiet-time session, for watching a queue."""
    window = F.session_window("ts", f"{quiet_seconds} seconds")
    return routed.withWatermark("ts", late).groupBy(tenant, window).agg(F.count("*").alias("n_events")).select(
        tenant, F.col("session_window.start").alias("batch_start"), F.col("session_window.end").alias("quiet_from"), "n_events")

