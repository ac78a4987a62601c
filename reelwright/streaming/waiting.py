"""Rows that wait in a table until they can be settled, over the micro-batches of a stream.

Waiting rows lie in buckets by key. Every bucket has a version, the micro-batch that wrote it last, and a time at which
the first of its rows falls due. A micro-batch reads and rewrites only buckets that it has new rows for or that hold
rows that have fallen due by the clock; all others stay as they are, however long their rows wait. So its work follows
the rows that come and settle, and rewriting a bucket puts its rows into as few files again. A manifest, one row per
bucket, names the versions after each micro-batch. A micro-batch that is run again starts from the manifest before it
and writes the same. No state lives in a task.

The clock is the latest time seen, held back by the allowed lateness. A stream that falls silent
moves it by ticks: rows that carry only a time (see ``with_ticks``), as a timer would.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Prepare = Callable[[DataFrame], DataFrame]
Settle = Callable[[DataFrame, Column], DataFrame]
Emit = Callable[[DataFrame, int], None]
ONCE = {"availableNow": True}
BUCKETS = 64
MANIFEST = "bucket int, version bigint, due timestamp, latest timestamp"
#: The manifest's row for the stream as a whole, with the latest time seen.
ALL = -1


def with_ticks(rows: DataFrame, ticks: DataFrame) -> DataFrame:
    """A stream joined by ticks (a column ``ts``), such as those of a rate source; other columns are null."""
    return rows.unionByName(ticks.select("ts"), allowMissingColumns=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store it lies, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def read_manifest(spark: SparkSession, state_dir: str, batch_id: int) -> dict:
    """The rows of the manifest after a micro-batch, by bucket; there are no more than buckets, plus one."""
    if batch_id < 0:
        return {}
    rows = spark.read.schema(MANIFEST).parquet(f"{state_dir}/manifest/{batch_id}").collect()
    return {r["bucket"]: r for r in rows}


def run_waiting(rows: DataFrame, prepare: Prepare, schema: str, settle: Settle, emit: Emit, state_dir: str, checkpoint: str,
                late_seconds: int, trigger: Mapping[str, object] = ONCE, key: Sequence[str] = (), due: Column | None = None,
                buckets: int = BUCKETS) -> StreamingQuery:
    """Start a stream whose rows wait until ``settle`` marks them in a column ``settled``.

    ``prepare`` turns a micro-batch into rows of ``schema``, which has a column ``ts``; ticks are not
    shown to it. ``settle`` gets rows and the clock, ``emit`` the settled rows. Whether a row is settled may depend on
    rows of the same ``key`` only (all rows, without one), and on the clock from ``due`` on (always, without one).
    ``state_dir`` must be a folder that every executor reaches.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int") if key else F.lit(0)
    falls_due = F.col("ts") if due is None else due
    # Without a key all rows are in one bucket, which several tasks must write.
    dealt = ["bucket"] if key else ["bucket", F.xxhash64(*[f.split()[0] for f in schema.split(", ")])]

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_manifest(spark, state_dir, batch_id - 1)
        payload = [F.col(c).isNotNull() for c in batch.columns if c != "ts"]
        filled = payload[0]
        for p in payload[1:]:
            filled = filled | p
        new = prepare(batch.where(filled)).withColumn("bucket", bucket)
        ticks = batch.where(~filled).groupBy().agg(F.max("ts").alias("ts"))
        new.unionByName(ticks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{state_dir}/seen")
        wide = f"{schema}, bucket int"
        seen = spark.read.schema(wide).parquet(f"{state_dir}/seen")
        met = seen.groupBy("bucket").agg(F.max("ts").alias("latest")).collect()  # one row per bucket
        times = [r["latest"] for r in (*met, *(before[b] for b in before if b == ALL)) if r["latest"] is not None]
        latest = max(times, default=None)
        clock = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {late_seconds} SECONDS")
        passed = spark.range(1).select(clock.alias("clock")).first()["clock"]
        touched = {r["bucket"] for r in met} - {None}
        touched |= {b for b, r in before.items() if b != ALL and r["due"] is not None and passed is not None and r["due"] <= passed}
        if due is None:
            touched |= set(before) - {ALL}
        paths = [f"{state_dir}/waiting/{before[b]['version']}/bucket={b}" for b in sorted(touched) if b in before]
        columns = [c for c in seen.columns if c != "bucket"]
        open_rows = seen.where("bucket IS NOT NULL").select(*columns)
        for path in paths:
            open_rows = open_rows.unionByName(spark.read.schema(schema).parquet(path).select(*columns))
        settle(open_rows, clock).select(*columns, "settled").write.mode("overwrite").parquet(f"{state_dir}/marked")
        marked = spark.read.schema(f"{schema}, settled boolean").parquet(f"{state_dir}/marked")
        emit(marked.where("settled").select(*columns), batch_id)
        rest = marked.where("NOT settled").select(*columns).withColumn("bucket", bucket)
        target = f"{state_dir}/waiting/{batch_id}"
        rest.repartition(*dealt).write.mode("overwrite").partitionBy("bucket").parquet(target)
        left = spark.read.schema(wide).parquet(target).groupBy("bucket").agg(F.min(falls_due).alias("due")).collect()
        after = [(b, r["version"], r["due"], None) for b, r in before.items() if b != ALL and b not in touched]
        after += [(r["bucket"], batch_id, r["due"], None) for r in left]
        manifest = spark.createDataFrame([*after, (ALL, batch_id, None, latest)], MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{state_dir}/manifest/{batch_id}")
        if batch_id > 1:  # what the manifest before last named and the last no longer does; no run goes back that far
            for b, r in read_manifest(spark, state_dir, batch_id - 2).items():
                if b != ALL and (b not in before or before[b]["version"] != r["version"]):
                    delete_folder(spark, f"{state_dir}/waiting/{r['version']}/bucket={b}")

    return (
        rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
