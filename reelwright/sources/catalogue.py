"""Scans of the catalogue: items by type, library, id, user; probes and id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright import schemas
from reelwright.functions.util import non_blank, provider_id


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A table in an explicit schema; JSON and CSV rows that do not fit become nulls."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def read_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, schemas.ITEMS, fmt)


def scan_items(items: DataFrame, types: Sequence[str], libraries: Sequence[str] | None = None,
               fields: Sequence[str] | None = None) -> DataFrame:
    """Items of some types in some libraries, only the wanted columns and the library tag."""
    rows = items.where(F.col("type").isin(*types))
    if libraries is not None:
        rows = rows.where(F.col("library").isin(*libraries))
    return rows.select(*dict.fromkeys([*fields, "library"])) if fields else rows


def scan_by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items with the asked ids; ids that no item has are dropped. Other id columns come along."""
    wanted = ids.dropDuplicates(["item_id"])
    extra = [c for c in wanted.columns if c != "item_id"]
    return items.join(wanted, "item_id") if extra else items.join(wanted, "item_id", "left_semi")


def resolve_libraries(libraries: DataFrame, names: DataFrame) -> DataFrame:
    """Asked library names (any case) with their id; null for the names that do not exist."""
    known = libraries.select(F.col("library_id"), F.lower("name").alias("_key"))
    return (
        names.withColumn("_key", F.lower("name")).join(known, "_key", "left")
        .select("name", "library_id")
    )


def missing_libraries(libraries: DataFrame, names: DataFrame) -> DataFrame:
    return resolve_libraries(libraries, names).where("library_id IS NULL").select("name")


def resolve_user(users: DataFrame, name: str | None, order: Sequence[Column]) -> DataFrame:
    """The user with this name in any case, else the first user."""
    match = F.coalesce(F.lower("user_name") == (name or "").lower(), F.lit(False))
    return users.orderBy(match.desc(), *order).limit(1)


def probe_library_content(items: DataFrame) -> DataFrame:
    """Movie and series counts per library, and the pass each library belongs to."""
    counts = items.groupBy("library").agg(
        F.count_if(F.col("type") == "Movie").alias("n_movies"),
        F.count_if(F.col("type") == "Series").alias("n_series"),
    )
    return counts.withColumn("in_movie_pass", F.col("n_movies") > 0).withColumn("in_series_pass", F.col("n_series") > 0)


def scan_paths(items: DataFrame) -> DataFrame:
    """Paths of movies and episodes, as they are."""
    return items.where(F.col("type").isin("Movie", "Episode") & non_blank(F.col("path"))).select("path")


def scan_children(episodes: DataFrame, series: DataFrame, season: int | None = None) -> DataFrame:
    """Episodes of the given series (of one season), tagged with the series' name."""
    rows = episodes if season is None else episodes.where(F.col("season") == season)
    heads = series.select(F.col("item_id").alias("series_id"), F.col("name").alias("parent_name"))
    return rows.join(heads, "series_id")


def series_seasons(episodes: DataFrame) -> DataFrame:
    """Seasons of each series with their episode count."""
    return episodes.where("series_id IS NOT NULL AND season IS NOT NULL").groupBy("series_id", "season").agg(
        F.count("*").alias("n_episodes"))


def scan_users(users: DataFrame) -> DataFrame:
    return users.where(non_blank(F.col("user_id"))).select("user_id", "user_name")


def scan_genres(items: DataFrame) -> DataFrame:
    """All distinct genres."""
    return items.select(F.explode("genres").alias("genre")).distinct()


def library_ids(items: DataFrame, provider: str) -> DataFrame:
    """Distinct ids of one provider that the library owns, with a name."""
    rows = items.select("type", provider_id(F.col("provider_ids"), provider).alias("id"), "name")
    return rows.where(non_blank(F.col("id"))).groupBy("type", "id").agg(F.min("name").alias("name"))


def scan_playback(activity: DataFrame) -> DataFrame:
    """Start and stop events in the five playback columns (and the event id)."""
    return activity.where(F.col("type").isin("playback.start", "playback.stop")).select(
        "event_id", "type", "ts", "user_id", "item_id", "name")
