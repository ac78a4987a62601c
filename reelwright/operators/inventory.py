"""File inventory kept up to date from scans: state table, run log and archive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright import constants as K


def dv_profile(side_data: Column) -> Column:
    """Dolby Vision profile of the first side-data entry that names one."""
    named = F.filter(side_data, lambda s: s["dv_profile"].isNotNull())
    return F.try_element_at(named, F.lit(1))["dv_profile"]


def is_problematic(profile: Column) -> Column:
    return F.coalesce(profile == K.PROBLEM_PROFILE, F.lit(False))


def derive_status(profile: Column, previous: Column) -> Column:
    """Earlier decisions stick; otherwise the profile decides."""
    return (
        F.when(previous.isin(*K.STICKY_STATUSES), previous)
        .when(is_problematic(profile), "needs_rebuild").otherwise("ok")
    )


def compared(state: DataFrame, scan: DataFrame, full: bool = False) -> DataFrame:
    """Every path of either side with ``change``: the scan's columns, and the state's as ``old_`` ones.

    One join, so that a state that is bucketed by path is not shuffled. ``full`` treats known files as changed, so that
    they are probed again.
    """
    kept = {"path": "_old", "size": "old_size", "mtime": "old_mtime", "dv_profile": "old_profile", "status": "old_status",
            "first_seen": "old_first_seen", "fail_count": "old_fail_count"}
    old = state.select(*[F.col(c).alias(n) for c, n in kept.items()])
    same = (F.col("size") == F.col("old_size")) & (
        F.abs(F.coalesce("old_mtime", F.lit(0.0)) - F.col("mtime")) < K.MTIME_TOLERANCE)
    change = (
        F.when(F.col("path").isNull(), "deleted").when(F.col("_old").isNull(), "new")
        .when(F.coalesce(same, F.lit(False)) & F.lit(not full), "unchanged").otherwise("changed")
    )
    both = old.join(scan, F.col("_old") == F.col("path"), "full_outer").withColumn("change", change)
    return both.withColumn("path", F.coalesce("path", "_old")).drop("_old")


def inventory_diff(state: DataFrame, scan: DataFrame, full: bool = False) -> DataFrame:
    """Every path of either side with its change: new, changed, unchanged or deleted."""
    return compared(state, scan.select("path", "size", "mtime"), full).select("path", "old_size", "old_mtime", "size", "mtime", "change")


def inventory_upsert(state: DataFrame, scan: DataFrame, now: dt.datetime | str, full: bool = False) -> DataFrame:
    """The next state: probed rows replaced, unchanged ones touched, vanished ones gone.

    ``first_seen`` stays; the scan carries the probe's side data of every file, which is read
    only where the file is new or changed.
    """
    at = F.lit(str(now)).cast("timestamp")
    rows = compared(state, scan.select("path", "size", "mtime", "side_data"), full).where("change <> 'deleted'")
    touched = F.col("change") == "unchanged"
    profile = F.when(touched, F.col("old_profile")).otherwise(dv_profile(F.col("side_data")))
    rows = rows.withColumn("dv_profile", profile)
    return rows.select(
        "path", "size", "mtime", "dv_profile",
        F.when(touched, F.col("old_status")).otherwise(derive_status(F.col("dv_profile"), F.col("old_status"))).alias("status"),
        F.when(touched, F.col("old_first_seen")).otherwise(F.coalesce("old_first_seen", at)).alias("first_seen"),
        at.alias("last_checked"), F.coalesce("old_fail_count", F.lit(0)).alias("fail_count"), "change",
    )


def inventory_archive(state: DataFrame, scan: DataFrame, now: dt.datetime | str) -> DataFrame:
    """Vanished rows with their last status, to append to the archive."""
    gone = state.join(scan.select("path"), "path", "left_anti")
    return gone.select(
        "path", "size", F.col("dv_profile").isNotNull().alias("is_dv"), is_problematic(F.col("dv_profile")).alias("problematic"),
        F.col("status").alias("last_status"), "first_seen", F.lit(str(now)).cast("timestamp").alias("removed_at"),
    )


def inventory_run_log(state: DataFrame, next_state: DataFrame, scan: DataFrame, now: dt.datetime | str) -> DataFrame:
    """One row of counters of a run."""
    pile = is_problematic(F.col("dv_profile")) & (F.col("status") == "needs_rebuild")
    live = next_state.select("change", pile.alias("pile"))
    gone = state.join(scan.select("path"), "path", "left_anti").select(F.lit("deleted").alias("change"), F.lit(False).alias("pile"))
    change = F.col("change")
    return live.unionByName(gone).agg(
        F.count_if(change != "deleted").alias("total"), F.count_if(change.isin("new", "changed")).alias("probed"),
        F.count_if(change == "new").alias("new"), F.count_if(change == "changed").alias("changed"),
        F.count_if(change == "deleted").alias("deleted"), F.count_if("pile").alias("problematic"),
    ).withColumn("ts", F.lit(str(now)).cast("timestamp"))


# ------------------------------------------------------------------------------ reports


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n_files"), F.count("dv_profile").alias("n_dv"))


def rebuild_pile(state: DataFrame) -> DataFrame:
    """Files to rebuild, by path."""
    return state.where(is_problematic(F.col("dv_profile")) & (F.col("status") == "needs_rebuild")).select("path", "dv_profile").orderBy("path")


def first_seen_in(state: DataFrame, run: dt.datetime | str) -> DataFrame:
    """Files first seen in a run, with what the probe said of them."""
    flag = F.when(is_problematic(F.col("dv_profile")), "PROBLEMATIC").when(F.col("dv_profile").isNotNull(), "DV-ok").otherwise("")
    return state.where(F.col("first_seen") == F.lit(str(run)).cast("timestamp")).select("path", flag.alias("flag"))


def resolved(state: DataFrame, next_state: DataFrame) -> DataFrame:
    """Files that were to be rebuilt and whose new version is clean."""
    was = state.where("status = 'needs_rebuild'").select("path")
    clean = next_state.where(F.col("change").isin("new", "changed") & ~is_problematic(F.col("dv_profile")))
    return clean.join(was, "path", "left_semi").select("path")


def removed_history(archive: DataFrame) -> DataFrame:
    return archive.orderBy(F.desc("removed_at"), "path")


def last_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    return runs.orderBy(F.desc("ts")).limit(n)


def good_count(state: DataFrame) -> DataFrame:
    return state.agg(F.count_if(F.col("status").isin("ok", "converted")).alias("n_good"))


# ------------------------------------------------------------------------------ updates


def record_failure(state: DataFrame, failures: DataFrame) -> DataFrame:
    """State after conversion failures (path, one row each); three failures mark a file failed."""
    counts = failures.groupBy("path").agg(F.count("*").alias("_n"))
    total = F.coalesce("fail_count", F.lit(0)) + F.coalesce("_n", F.lit(0)).cast("int")
    status = F.when((F.col("_n") > 0) & (total >= K.FAIL_THRESHOLD), "failed").otherwise(F.col("status"))
    return state.join(counts, "path", "left").withColumns({"status": status, "fail_count": total}).drop("_n")


def mark_status(state: DataFrame, marks: DataFrame) -> DataFrame:
    """State after setting statuses by path; of several marks of a path the last in order of text holds.

    Marks with an unknown status change nothing; ``refused_marks`` has them.
    """
    wanted = marks.where(F.col("status").isin(*K.SETTABLE_STATUSES)).groupBy("path").agg(F.max("status").alias("_set"))
    return state.join(wanted, "path", "left").withColumn("status", F.coalesce("_set", "status")).drop("_set")


def refused_marks(marks: DataFrame) -> DataFrame:
    """The marks whose status cannot be set."""
    return marks.where(~F.coalesce(F.col("status").isin(*K.SETTABLE_STATUSES), F.lit(False)))
