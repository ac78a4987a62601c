"""Retention rules: which titles have earned removal, and why the others have not."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions import dates
from reelwright.functions.util import contains_any, non_blank


@dataclass(frozen=True)
class RetentionParams:
    """Settings of a clean-up run; ``as_of`` is the day ages are counted to."""

    as_of: dt.date | str
    min_age_years: float = 3
    base_rating: float = 6.0
    decay_step: float = 0.5
    max_rating: float = 8.0
    no_actor_protection_after_years: float = 10
    masterpiece_only_after_years: float = 12
    masterpiece_rating: float = 9.0
    protect_paths: Sequence[str] = ("/Dokumenty/",)
    excluded_provider_ids: Sequence[str] = ()
    top_actors: int = 50
    near_miss_count: int = 5


MOVIE_STAGES = ("age_filtered", "excluded_filtered", "play_protected", "interest_protected",
                "actor_protected", "franchise_protected", "path_protected", "rating_protected",
                "candidate")
SERIES_STAGES = ("stale_filtered", "excluded_filtered", "play_protected", "favorite_protected",
                 "path_protected", "rating_protected", "candidate")


# ------------------------------------------------------------------------ expressions


def rating_threshold(age: Column, p: RetentionParams) -> Column:
    """Rating a title of this age must reach."""
    raised = F.lit(float(p.base_rating)) + (age - F.lit(float(p.min_age_years))) * F.lit(float(p.decay_step))
    return F.least(raised, F.lit(float(p.max_rating)))


def effective_rating(community: Column, critic: Column) -> Column:
    """Mean of both ratings on one scale, or the one there is, or 0."""
    press = critic / F.lit(10.0)
    return F.coalesce((community + press) / F.lit(2.0), community, press, F.lit(0.0))


def days_until_candidate(rating: Column, age: Column, p: RetentionParams) -> Column:
    """Days until the rising threshold passes the rating; null when it never will."""
    crossing = F.when(
        rating <= p.max_rating,
        (rating - F.lit(float(p.base_rating))) / F.lit(float(p.decay_step)) + F.lit(float(p.min_age_years)),
    )
    target = F.least(crossing, F.lit(float(p.masterpiece_only_after_years)))
    days = F.greatest((target - age) * F.lit(365.25), F.lit(0.0)).cast("int")
    return F.when(rating < p.masterpiece_rating, days)


def is_franchise(provider_ids: Column) -> Column:
    return F.coalesce(
        F.exists(F.map_keys(provider_ids), lambda k: F.lower(k) == "tmdbcollection"), F.lit(False)
    )


def is_path_protected(path: Column, protect_paths: Sequence[str]) -> Column:
    return contains_any(path, [p for p in protect_paths if p])


def is_excluded(provider_ids: Column, excluded: Sequence[str]) -> Column:
    if not excluded:
        return F.lit(False)
    return F.coalesce(F.exists(F.map_values(provider_ids), lambda v: v.isin(*excluded)), F.lit(False))


def actor_names(people: Column) -> Column:
    actors = F.filter(people, lambda p: p["type"] == "Actor")
    return F.array_distinct(F.transform(actors, lambda p: p["name"]))


def with_protection_flags(items: DataFrame, p: RetentionParams) -> DataFrame:
    """Adds what each protection rule reads from the row itself."""
    return items.select(
        "*",
        is_franchise(F.col("provider_ids")).alias("franchise"),
        is_path_protected(F.col("path"), p.protect_paths).alias("path_protected"),
        is_excluded(F.col("provider_ids"), p.excluded_provider_ids).alias("excluded"),
    )


# --------------------------------------------------------------------------- user facts


def favorite_people(favorites: DataFrame, items: DataFrame, plays: DataFrame, p: RetentionParams) -> DataFrame:
    """Distinct favourite names of all users; without any, the primary user's commonest actors.

    ``favorites`` has a name column, ``plays`` the ids of movies the primary user played.
    """
    named = favorites.where(non_blank(F.col("name"))).select("name").distinct()
    played = items.where("type = 'Movie'").join(plays.select("item_id").distinct(), "item_id", "left_semi")
    common = (
        played.select(F.explode("people").alias("person")).where("person.type = 'Actor'")
        .groupBy(F.col("person.name").alias("name")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "name").limit(p.top_actors)
    )
    return named.unionByName(common.where(~named.exists()).select("name"))


def any_user_status(user_data: DataFrame) -> DataFrame:
    """Per item whether any user played it, or marked or began it."""
    interested = F.coalesce("is_favorite", F.lit(False)) | (F.coalesce("position_ticks", F.lit(0)) > 0)
    return user_data.groupBy("item_id").agg(
        F.bool_or(F.coalesce("played", F.lit(False))).alias("played"),
        F.bool_or(interested).alias("interested"),
    )


def series_user_status(user_data: DataFrame, series: DataFrame) -> DataFrame:
    """Per series whether any user played some of it, or marked it.

    The rows are reduced per series first: only the least unplayed count can matter.
    """
    reduced = user_data.groupBy("item_id").agg(
        F.bool_or(F.coalesce("played", F.lit(False))).alias("any_played"),
        F.bool_or(F.coalesce("is_favorite", F.lit(False))).alias("favorited"),
        F.min("unplayed_item_count").alias("unplayed"),
    )
    total = F.coalesce("recursive_item_count", F.lit(0))
    joined = reduced.join(series.select("item_id", "recursive_item_count"), "item_id")
    begun = (total > 0) & (F.coalesce("unplayed", total) < total)
    return joined.select("item_id", (F.col("any_played") | begun).alias("played"), "favorited")


def last_episode_added(episodes: DataFrame) -> DataFrame:
    """Latest added date per series, blanks skipped; dates compare as ISO text."""
    return (
        episodes.where(non_blank(F.col("series_id")) & non_blank(F.col("date_created")))
        .groupBy("series_id").agg(F.max("date_created").alias("last_added"))
    )


def series_sizes(episodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Total episode size of the wanted series only."""
    ids = wanted.select(F.col("item_id").alias("series_id"))
    return (
        episodes.select("series_id", "size").join(ids, "series_id", "left_semi")
        .groupBy("series_id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("size_bytes"))
    )


# ------------------------------------------------------------------------------ rules


def classify_movies(movies: DataFrame, status: DataFrame, favorites: DataFrame, p: RetentionParams) -> DataFrame:
    """Movies with age, threshold, rating and the stage that settles them.

    Stages are tried in this order: age, exclusion, play, interest, path, the masterpiece gate
    of old titles, favourite actor, franchise, rating.
    """
    starred = (
        movies.select("item_id", F.explode(actor_names(F.col("people"))).alias("name"))
        .join(favorites.select("name"), "name", "left_semi")
        .select("item_id").distinct().withColumn("starred", F.lit(True))
    )
    rows = (
        with_protection_flags(movies, p)
        .withColumn("age", dates.age_years(F.col("date_created"), p.as_of))
        .join(status, "item_id", "left")
        .join(starred, "item_id", "left")
        .withColumn("threshold", rating_threshold(F.col("age"), p))
        .withColumn("effective", effective_rating(F.col("community_rating"), F.col("critic_rating")))
    )
    age, rating = F.col("age"), F.col("effective")
    old = age >= p.masterpiece_only_after_years
    stage = (
        F.when(age < p.min_age_years, "age_filtered")
        .when(F.col("excluded"), "excluded_filtered")
        .when(F.col("played"), "play_protected")
        .when(F.col("interested"), "interest_protected")
        .when(F.col("path_protected"), "path_protected")
        .when(old & (rating >= p.masterpiece_rating), "rating_protected")
        .when(old, "candidate")
        .when((age < p.no_actor_protection_after_years) & F.col("starred"), "actor_protected")
        .when(F.col("franchise"), "franchise_protected")
        .when(rating >= F.col("threshold"), "rating_protected")
        .otherwise("candidate")
    )
    shown = F.when(old & (F.col("stage") == "candidate"), F.lit(float(p.masterpiece_rating))).otherwise(
        F.col("threshold")
    )
    return rows.withColumn("stage", stage).withColumn("threshold", shown)


def classify_series(series: DataFrame, status: DataFrame, last_added: DataFrame, p: RetentionParams) -> DataFrame:
    """Series with staleness (years since their last episode), threshold and stage."""
    rows = (
        with_protection_flags(series, p)
        .join(last_added.withColumnRenamed("series_id", "item_id"), "item_id", "left")
        .join(status, "item_id", "left")
        .withColumn("age", dates.age_years(F.col("last_added"), p.as_of))
        .withColumn("threshold", rating_threshold(F.col("age"), p))
        .withColumn("effective", effective_rating(F.col("community_rating"), F.col("critic_rating")))
    )
    stage = (
        F.when(F.col("age") < p.min_age_years, "stale_filtered")
        .when(F.col("excluded"), "excluded_filtered")
        .when(F.col("played"), "play_protected")
        .when(F.col("favorited"), "favorite_protected")
        .when(F.col("path_protected"), "path_protected")
        .when(F.col("effective") >= F.col("threshold"), "rating_protected")
        .otherwise("candidate")
    )
    return rows.withColumn("stage", stage)


def cleanup_funnel(classified: DataFrame, stages: Sequence[str]) -> DataFrame:
    """One row of counters, zeros included."""
    return classified.agg(
        F.count("*").alias("total_analyzed"),
        *[F.count_if(F.col("stage") == s).alias(s) for s in stages],
    )


def candidates(classified: DataFrame) -> DataFrame:
    return classified.where("stage = 'candidate'")


def near_miss(classified: DataFrame, p: RetentionParams) -> DataFrame:
    """Titles that only their rating protects, soonest first; all of them when the count is 0."""
    rows = classified.where("stage = 'rating_protected'").withColumn(
        "days_left", days_until_candidate(F.col("effective"), F.col("age"), p)
    )
    ordered = rows.orderBy(F.asc_nulls_last("days_left"), "item_id")
    return ordered.limit(p.near_miss_count) if p.near_miss_count > 0 else ordered


def reclaimable_size(candidate_rows: DataFrame) -> DataFrame:
    return candidate_rows.agg(
        F.count("*").alias("n_candidates"),
        F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)).alias("size_bytes"),
    )
