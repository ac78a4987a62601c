"""The file inventory as a log of file versions, with the history of its runs.

A run appends the versions that are new, changed or deleted, and nothing for files that stayed as they were, so what it
writes follows the changes and not the inventory. The log is bucketed by path: the newest version of each path is found, and
compared with a scan, inside a bucket. Only the scan is shuffled. When a file was last checked is not kept per file; it is
the time of the last run.

A run counts once its row stands in the table of runs, which is written last. Rows of a run that broke off have a run id
that never gets there, and are read by nobody; the run is simply made again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.operators.inventory import compared, derive_status, dv_profile, is_problematic

VERSION = "path string, size long, mtime double, dv_profile int, status string, first_seen timestamp, fail_count int"
BEFORE = "old_status string, old_profile int, old_size long"
LOG = f"{VERSION}, change string, {BEFORE}, run string, run_at timestamp"
RUNS = "run string, run_at timestamp, total long, probed long, new long, changed long, deleted long, problematic long"
NAMES = [part.split()[0] for part in LOG.split(", ")]
GONE = "deleted"


def _in_pile(profile: str, status: str) -> Column:
    return F.coalesce(is_problematic(F.col(profile)) & (F.col(status) == "needs_rebuild"), F.lit(False)).cast("int")


@dataclass(frozen=True)
class InventoryLog:
    """The log under ``path``, known to the session's catalogue as ``name``; the number of buckets is set once and for all."""

    spark: SparkSession
    name: str
    path: str
    buckets: int = 64

    def create(self) -> InventoryLog:
        """Make the tables known to the session; what lies in the folder stays."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({LOG}) USING parquet "
            f"CLUSTERED BY (path) SORTED BY (path) INTO {self.buckets} BUCKETS LOCATION '{self.path}/log'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_runs ({RUNS}) USING parquet LOCATION '{self.path}/runs'")
        return self

    # ---------------------------------------------------------------------- reading

    def runs(self) -> DataFrame:
        """Committed runs with their counters, marks and failures among them."""
        return self.spark.table(f"{self.name}_runs")

    def versions(self) -> DataFrame:
        """Every version of every file that a committed run wrote, deletions among them."""
        return self.spark.table(self.name).join(self.runs().select("run"), "run", "left_semi")

    def as_of(self, at: dt.datetime | str | None = None) -> DataFrame:
        """The files as they stood at a time, by default now, with ``last_checked``."""
        until = F.lit(True) if at is None else F.col("run_at") <= F.lit(str(at)).cast("timestamp")
        row = F.struct(*[c for c in NAMES if c != "path"])
        # Two entries of one time are told apart by their run id, so that repeated reads agree.
        newest = self.versions().where(until).groupBy("path").agg(F.max_by(row, F.struct("run_at", "run")).alias("v"))
        checked = self.runs().where(until & F.col("total").isNotNull()).agg(F.date_format(F.max("run_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).first().at
        live = newest.where(F.col("v.change") != GONE).select("path", *[F.col(f"v.{c}").alias(c) for c in NAMES if c != "path"])
        return live.withColumn("last_checked", F.lit(checked).cast("timestamp"))

    def history(self) -> DataFrame:
        """File versions with the time from which and, unless they still hold, until which they held."""
        later = Window.partitionBy("path").orderBy("run_at", "run")
        spans = self.versions().withColumn("valid_to", F.lead("run_at").over(later)).withColumnRenamed("run_at", "valid_from")
        return spans.where(F.col("change") != GONE)

    def removed(self) -> DataFrame:
        """Files that went, newest first: what they were and when they went. A path may go more than once."""
        gone = self.versions().where(F.col("change") == GONE)
        return gone.select(
            "path", F.col("old_size").alias("size"), F.col("old_profile").isNotNull().alias("is_dv"),
            is_problematic(F.col("old_profile")).alias("problematic"), F.col("old_status").alias("last_status"),
            "first_seen", F.col("run_at").alias("removed_at"),
        ).orderBy(F.desc("removed_at"), "path")

    def resolved(self) -> DataFrame:
        """Files that were to be rebuilt and came back clean, with the run that saw it."""
        clean = F.col("change").isin("new", "changed") & ~is_problematic(F.col("dv_profile"))
        return self.versions().where(clean & (F.col("old_status") == "needs_rebuild")).select("path", F.col("run_at").alias("resolved_at"))

    def first_seen_in(self, at: dt.datetime | str) -> DataFrame:
        """Files that a run saw first, with what the probe said of them."""
        flag = F.when(is_problematic(F.col("dv_profile")), "PROBLEMATIC").when(F.col("dv_profile").isNotNull(), "DV-ok").otherwise("")
        return self.versions().where((F.col("change") == "new") & (F.col("run_at") == F.lit(str(at)).cast("timestamp"))).select("path", flag.alias("flag"))

    def last_runs(self, n: int = 25) -> DataFrame:
        """The counters of the last runs over a scan, newest first."""
        return self.runs().where(F.col("total").isNotNull()).drop("run").orderBy(F.desc("run_at")).limit(n)

    # ---------------------------------------------------------------------- writing

    def changes(self, scan: DataFrame, at: dt.datetime | str, full: bool = False) -> DataFrame:
        """The versions that a run over a scan (path, size, mtime, side_data) adds."""
        rows = compared(self.as_of().drop("change", *[p.split()[0] for p in BEFORE.split(", ")]), scan, full)
        gone = F.col("change") == GONE
        profile = F.when(~gone, dv_profile(F.col("side_data")))
        rows = rows.where("change <> 'unchanged'").withColumn("dv_profile", profile)
        return rows.select(
            "path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"),
            F.col("dv_profile").cast("int").alias("dv_profile"),
            F.when(~gone, derive_status(F.col("dv_profile"), F.col("old_status"))).alias("status"),
            F.coalesce("old_first_seen", F.lit(str(at)).cast("timestamp")).alias("first_seen"),
            F.coalesce("old_fail_count", F.lit(0)).cast("int").alias("fail_count"), "change",
            "old_status", F.col("old_profile").cast("int").alias("old_profile"), F.col("old_size").cast("long").alias("old_size"),
        )

    def record(self, scan: DataFrame, at: dt.datetime | str, full: bool = False) -> str:
        """Add a run over a scan and commit it with its counters; returns the run's id."""
        run = self._append(self.changes(scan, at, full), at)
        change = F.col("change")
        counted = self.spark.table(self.name).where(F.col("run") == run).agg(
            F.count_if(change == "new").alias("new"), F.count_if(change == "changed").alias("changed"),
            F.count_if(change == GONE).alias("deleted"))
        n = counted.first()
        before = self.last_runs(1).first()
        total = (before.total if before else 0) + n.new - n.deleted
        # Marks and failures since the last run moved the pile, too: all entries since then count.
        since = F.col("run_at") > F.lit(before.run_at) if before else F.lit(True)
        own = self.versions().where(since).select("dv_profile", "status", "old_profile", "old_status").unionByName(
            self.spark.table(self.name).where(F.col("run") == run).select("dv_profile", "status", "old_profile", "old_status"))
        moved = own.agg(F.coalesce(F.sum(_in_pile("dv_profile", "status") - _in_pile("old_profile", "old_status")), F.lit(0)).alias("n")).first().n
        self._commit(run, at, (total, n.new + n.changed, n.new, n.changed, n.deleted, (before.problematic if before else 0) + moved))
        return run

    def mark(self, marks: DataFrame, at: dt.datetime | str) -> str:
        """Set statuses (path, status) of known files; of several marks of a path the last in order of text holds."""
        wanted = marks.where(F.col("status").isin(*K.SETTABLE_STATUSES)).groupBy("path").agg(F.max("status").alias("_set"))
        rows = self.as_of().join(wanted, "path").where("NOT (status <=> _set)")
        return self._entries(rows, F.col("_set"), F.col("fail_count"), "marked", at)

    def fail(self, failures: DataFrame, at: dt.datetime | str) -> str:
        """Count conversion failures (path, one row each) of known files; at the threshold a file is failed."""
        counts = failures.groupBy("path").agg(F.count("*").cast("int").alias("_n"))
        total = F.col("fail_count") + F.col("_n")
        status = F.when(total >= K.FAIL_THRESHOLD, "failed").otherwise(F.col("status"))
        return self._entries(self.as_of().join(counts, "path"), status, total, "failure", at)

    def _entries(self, rows: DataFrame, status: Column, fail_count: Column, change: str, at: dt.datetime | str) -> str:
        run = self._append(rows.select(
            "path", "size", "mtime", "dv_profile", status.alias("status"), "first_seen", fail_count.alias("fail_count"),
            F.lit(change).alias("change"), F.col("status").alias("old_status"), F.col("dv_profile").alias("old_profile"),
            F.col("size").alias("old_size"),
        ), at)
        self._commit(run, at, (None,) * 6)
        return run

    def _append(self, rows: DataFrame, at: dt.datetime | str) -> str:
        run = uuid.uuid4().hex
        full = rows.withColumn("run", F.lit(run)).withColumn("run_at", F.lit(str(at)).cast("timestamp")).select(*NAMES)
        full.write.bucketBy(self.buckets, "path").sortBy("path").format("parquet").mode("append").saveAsTable(self.name)
        return run

    def _commit(self, run: str, at: dt.datetime | str, counters: tuple[int | None, ...]) -> None:
        row = self.spark.createDataFrame([(run, str(at), *counters)], RUNS.replace("run_at timestamp", "run_at string"))
        row.withColumn("run_at", F.col("run_at").cast("timestamp")).coalesce(1).write.insertInto(f"{self.name}_runs")
