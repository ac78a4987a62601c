"""Provider-id index, duplicate keys and the edges between copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.constants import PLACEHOLDER_IMDB, PROVIDERS
from reelwright.functions.util import lower_keys, non_blank
from reelwright.operators.grouping import grouped, spread_join

INDEX_COLUMNS = ("provider", "pid", "item_id", "library", "is_episode", "series_name", "season", "episode")


def _info(items: DataFrame) -> DataFrame:
    return items.withColumn("is_episode", non_blank(F.col("series_name")))


def provider_index(items: DataFrame) -> DataFrame:
    """One row per (provider, id, item) of the items that are no folders."""
    exploded = (
        _info(items)
        .where(~F.coalesce("is_folder", F.lit(False)))
        .select("*", F.explode(lower_keys(F.col("provider_ids"))).alias("provider", "pid"))
    )
    usable = (
        F.col("provider").isin(*PROVIDERS)
        & non_blank(F.col("pid"))
        & ~((F.col("provider") == "imdb") & (F.col("pid") == PLACEHOLDER_IMDB))
    )
    return exploded.where(usable).select(*INDEX_COLUMNS)


def series_episode_index(items: DataFrame) -> DataFrame:
    """Fallback key "Series|S1E2" for numbered episodes, one row per key, item and library."""
    numbered = _info(items).where(
        ~F.coalesce("is_folder", F.lit(False))
        & F.col("is_episode") & F.col("season").isNotNull() & F.col("episode").isNotNull()
    )
    key = F.concat(F.col("series_name"), F.lit("|S"), F.col("season").cast("string"),
                   F.lit("E"), F.col("episode").cast("string"))
    return (
        numbered.withColumn("provider", F.lit("series_episode")).withColumn("pid", key)
        .select(*INDEX_COLUMNS)
        .distinct()
    )


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """All entries of several indexes; repeats are kept."""
    merged = indexes[0]
    for index in indexes[1:]:
        merged = merged.unionByName(index)
    return merged


def identify_duplicates(index: DataFrame, excluded_ids: Sequence[str] = ()) -> DataFrame:
    """Keys (provider, pid) shared by more than one item, without the excluded ids."""
    allowed = index.where(~F.col("pid").isin(*excluded_ids)) if excluded_ids else index
    return (
        allowed.groupBy("provider", "pid")
        .agg(F.countDistinct("item_id").alias("n_items"))
        .where("n_items > 1")
    )


def link_key() -> Column:
    """What two copies must share: the id, and for numbered episodes the episode too."""
    numbered = F.col("is_episode") & F.col("season").isNotNull() & F.col("episode").isNotNull()
    return F.when(
        numbered,
        F.concat_ws("|", F.lit("ep"), F.col("pid"), F.col("series_name"),
                    F.concat(F.lit("S"), F.col("season").cast("string"),
                             F.lit("E"), F.col("episode").cast("string"))),
    ).otherwise(F.concat_ws("|", F.lit("id"), F.col("pid")))


def duplicate_edges(index: DataFrame, excluded_ids: Sequence[str] = ()) -> DataFrame:
    """Star edges (src, dst): each item of a link key points at the smallest item of it.

    A star has one edge per item, so a key held by a third of all items costs no pairs; the
    centre is an aggregate that combines before the shuffle. The edges of an item come out together,
    so that the component search can join them in one task.
    """
    allowed = index.where(~F.col("pid").isin(*excluded_ids)) if excluded_ids else index
    members = allowed.select("provider", link_key().alias("link"), "item_id")
    centres = grouped(members, ["provider", "link"]).agg(
        F.min("item_id").alias("dst"), F.max("item_id").alias("_last")
    ).where("dst <> _last").drop("_hash", "_last")
    return (
        spread_join(members, centres, ["provider", "link"])
        .where("item_id <> dst")
        .select(F.col("item_id").alias("src"), "dst")
        .repartition("src")
        .distinct()
    )


def item_metadata(index: DataFrame) -> DataFrame:
    """One info row per item; of several entries the last by (provider, pid, library) stays."""
    info = F.struct("provider", "pid", "library", "is_episode", "series_name", "season", "episode")
    last = index.groupBy("item_id").agg(F.max(info).alias("i"))
    return last.select("item_id", "i.*")
