"""Late and repeated rows of a stream, set aside and counted.

The clock after a micro-batch is the latest time seen so far, held back by the allowed lateness. A row that comes behind
the clock of the micro-batches before its own is late: it goes to a side table instead of the kept rows. A row whose key was kept
before, and is not behind the clock yet, is a repeat. As a row behind the clock is late anyway, only the kept rows
that are not behind it have to be looked at, in segments by micro-batch of which those behind the clock as a whole are left out.

Kept, late and repeated rows are segments named by their micro-batch, so one that is run again writes the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelwright.streaming.waiting import ONCE

CLOCK = "batch bigint, oldest timestamp, newest timestamp, clock timestamp, kept bigint, late bigint, repeated bigint"


def run_late(rows: DataFrame, key: Sequence[str], out_dir: str, checkpoint: str, late_seconds: int,
             trigger: Mapping[str, object] = ONCE) -> StreamingQuery:
    """Start a stream that parts its rows (with a column ``ts``) into ``out_dir``/kept, /late and /repeated, and counts them.

    Rows without a time are late. Of several rows of a key in one micro-batch the first by time stays, and of equal times any.
    Keys are compared with nulls equal.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        told = counts(spark, out_dir, batch_id).collect()  # one row per micro-batch
        clock = max((r["clock"] for r in told if r["clock"] is not None), default=None)
        limit = F.lit(clock).cast("timestamp")
        late = F.coalesce(F.col("ts") < limit, F.col("ts").isNull())
        batch.withColumn("_late", late).write.mode("overwrite").parquet(f"{out_dir}/seen")
        seen = spark.read.parquet(f"{out_dir}/seen")
        in_time = seen.where("NOT _late").drop("_late")
        for name in batch.columns:
            if name.startswith("_"):
                raise ValueError(f"column {name}: names with an underscore are taken")
        own = F.struct(*[F.col(k) for k in key])
        first = in_time.withColumn("_key", own).groupBy("_key").agg(
            F.min_by(F.struct(*batch.columns), F.struct("ts", F.xxhash64(*batch.columns))).alias("_row"), F.count("*").alias("_n"))
        open_ones = [r["batch"] for r in told if r["newest"] is not None and (clock is None or r["newest"] >= clock)]
        old = spark.read.schema(batch.schema).parquet(*[f"{out_dir}/kept/batch={b}" for b in open_ones]) if open_ones else in_time.limit(0)
        known = old.where(F.coalesce(F.col("ts") >= limit, F.lit(True))).select(own.alias("_key")).distinct()
        met = first.join(known.withColumn("_met", F.lit(True)), first["_key"].eqNullSafe(known["_key"]), "left").drop(known["_key"])
        met.write.mode("overwrite").parquet(f"{out_dir}/firsts")
        met = spark.read.parquet(f"{out_dir}/firsts")
        kept = met.where("_met IS NULL").select("_row.*")
        kept.write.mode("overwrite").parquet(f"{out_dir}/kept/batch={batch_id}")
        again = met.select("_key.*", (F.col("_n") - F.when(F.col("_met").isNull(), 1).otherwise(0)).alias("n")).where("n > 0")
        again.write.mode("overwrite").parquet(f"{out_dir}/repeated/batch={batch_id}")
        seen.where("_late").drop("_late").write.mode("overwrite").parquet(f"{out_dir}/late/batch={batch_id}")
        kept = spark.read.schema(batch.schema).parquet(f"{out_dir}/kept/batch={batch_id}")
        ends = kept.agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.count("*").alias("kept"))
        others = seen.agg(F.max("ts").alias("latest"), F.count_if("_late").alias("late"), F.count("*").alias("rows"))
        held_back = F.col("latest") - F.expr(f"INTERVAL {late_seconds} SECONDS")
        row = ends.join(others).select(
            F.lit(batch_id).cast("bigint").alias("batch"), "oldest", "newest", F.greatest(held_back, limit).alias("clock"), "kept", "late",
            (F.col("rows") - F.col("kept") - F.col("late")).alias("repeated"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/counts/batch={batch_id}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def counts(spark: SparkSession, out_dir: str, before: int) -> DataFrame:
    """One row per micro-batch up to ``before``: its ends, the clock after it, and its rows kept, late and repeated."""
    if not before:
        return spark.createDataFrame([], CLOCK)
    return spark.read.schema(CLOCK).parquet(*[f"{out_dir}/counts/batch={b}" for b in range(before)])
