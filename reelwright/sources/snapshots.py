"""Provider snapshots with a time to live: committed versions, and a keyed store for single entries.

A snapshot folder holds versions, each a folder with all entries, and commits, each an empty table written after its
version is whole. Readers take the newest version that has a commit, so a write that breaks off is never seen, and a
reader of the old version keeps its files until the version expires. Writers name versions by time and a random part, so
two writers never share a folder.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.constants import SNAPSHOT_TTL_SECONDS
from reelwright.functions.util import non_blank

VERSIONS_KEPT = 3
STORE_BUCKETS = 64
STORE = "namespace string, key string, value array<string>, fetched_at timestamp"
STATUSES = ("fresh", "negative", "stale", "missing")


def _status(known: Column, fetched_at: Column, has_data: Column, as_of: dt.datetime | str, ttl_seconds: int) -> Column:
    age = F.unix_timestamp(F.lit(str(as_of)).cast("timestamp")) - F.unix_timestamp(fetched_at)
    fresh = F.coalesce(age < ttl_seconds, F.lit(False))
    return F.when(known.isNull(), "missing").when(~fresh, "stale").when(has_data, "fresh").otherwise("negative")


def snapshot_freshness(requests: DataFrame, snapshot: DataFrame, as_of: dt.datetime | str, data: str,
                       ttl_seconds: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Requested keys as fresh, negative (fresh, known to have no data), stale or missing."""
    known = snapshot.select(
        "key", "fetched_at", F.col(data).isNotNull().alias("_has_data"), F.lit(True).alias("_known")
    )
    status = _status(F.col("_known"), F.col("fetched_at"), F.col("_has_data"), as_of, ttl_seconds)
    return requests.select("key").distinct().join(known, "key", "left").select("key", status.alias("status"))


def refresh_list(freshness: DataFrame) -> DataFrame:
    """Keys to fetch again."""
    return freshness.where(F.col("status").isin("missing", "stale")).select("key")


def merge_snapshot(snapshot: DataFrame, fetched: DataFrame) -> DataFrame:
    """Next version of a snapshot: fetched entries replace the ones they name."""
    kept = snapshot.join(fetched.select("key"), "key", "left_anti")
    return kept.unionByName(fetched)


# ------------------------------------------------------------------------------ versions


def _file_system(spark: SparkSession, path: str):
    """The store a folder lies in, and the folder's name there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def committed_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions, oldest first."""
    store, place = _file_system(spark, f"{path}/commits")
    if not store.exists(place):
        return []
    names = [s.getPath().getName() for s in store.listStatus(place)]
    done = [n for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{n}/_SUCCESS"))]
    return sorted(done)


def write_snapshot(snapshot: DataFrame, path: str, keep: int = VERSIONS_KEPT) -> str:
    """Write a version, then commit it; older versions than the newest ``keep`` expire. ``snapshot`` may read the old one."""
    spark = snapshot.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    snapshot.write.parquet(f"{path}/versions/{version}")
    # The commit tells how many files the version has; its own success file appears last.
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.parquet(f"{path}/commits/{version}")
    for old in committed_versions(spark, path)[:-keep]:
        for kind in ("commits", "versions"):  # the commit goes first, so no reader picks a version that is being removed
            store, place = _file_system(spark, f"{path}/{kind}/{old}")
            store.delete(place, True)
    return version


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest committed version; no rows if there is none."""
    versions = committed_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/versions/{versions[-1]}")


# --------------------------------------------------------------------------- keyed store


def store_key(provider: Column, external_id: Column, media_type: Column) -> Column:
    """The key of a lookup: ``tmdb_<id>_<type>`` where the provider tells types apart, else ``<provider>_<id>``."""
    typed = F.concat_ws("_", provider, external_id, media_type)
    return F.when(non_blank(external_id), F.when(provider == "tmdb", typed).otherwise(F.concat_ws("_", provider, external_id)))


def _bucketed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("bucket", F.pmod(F.xxhash64("namespace", "key"), F.lit(STORE_BUCKETS)).cast("int"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All entries of a keyed store, of every namespace; no rows if there is none yet."""
    store, place = _file_system(spark, path)
    if not store.exists(place):
        return spark.createDataFrame([], f"{STORE}, bucket int")
    return spark.read.schema(f"{STORE}, bucket int").parquet(path)


def merge_store(path: str, fetched: DataFrame) -> None:
    """Put fetched entries into the store, the newest of each key; an empty or null ``value`` is a negative entry.

    Only buckets that fetched entries fall into are read and rewritten: each is replaced as a whole partition, the others
    stay. Entries without a key are left out.
    """
    spark = fetched.sparkSession
    new = _bucketed(fetched.where("key IS NOT NULL").select(*[F.col(f.split()[0]) for f in STORE.split(", ")]))
    buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # no more than STORE_BUCKETS
    old = read_store(spark, path).where(F.col("bucket").isin(buckets))
    entry = F.struct("fetched_at", "value")
    merged = old.unionByName(new).groupBy("bucket", "namespace", "key").agg(F.max(entry).alias("e")).select(
        "namespace", "key", "e.value", "e.fetched_at", "bucket")
    # Written beside the store first, as the partitions that are replaced are read.
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    merged.write.parquet(staged)
    again = spark.read.schema(f"{STORE}, bucket int").parquet(staged)
    again.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
    store, place = _file_system(spark, staged)
    store.delete(place, True)


def look_up(requests: DataFrame, store: DataFrame, as_of: dt.datetime | str, ttl_seconds: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Requests (namespace, key) with ``status`` and, if fresh, ``value``; null keys are missing."""
    known = store.select("namespace", "key", "value", "fetched_at", F.lit(True).alias("_known"))
    has_data = F.coalesce(F.size("value") > 0, F.lit(False))
    status = _status(F.col("_known"), F.col("fetched_at"), has_data, as_of, ttl_seconds)
    found = requests.join(known, ["namespace", "key"], "left").withColumn("status", status)
    return found.withColumn("value", F.when(F.col("status") == "fresh", F.col("value"))).drop("fetched_at", "_known")
