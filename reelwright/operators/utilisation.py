"""How much of a library is watched: played sets, item facts and reports over them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.functions.dates import days_since
from reelwright.functions.streams import first_stream
from reelwright.functions.util import first_non_blank, non_blank
from reelwright.operators.folders import with_library
from reelwright.operators.grouping import counts_with_range, joined_top

NO_GENRE = "(No genre)"


def played_items(user_data: DataFrame) -> DataFrame:
    """Distinct items that any user played."""
    return user_data.where("played").select("item_id").distinct()


def played_series(user_data: DataFrame, episodes: DataFrame) -> DataFrame:
    """(series_id, user_id) for every user who played an episode of the series."""
    plays = user_data.where("played").select("user_id", "item_id").distinct()
    owners = episodes.where(non_blank(F.col("series_id"))).select("item_id", "series_id")
    return plays.join(owners, "item_id").select("series_id", "user_id").distinct()


def _common_facts(as_of: dt.date | str) -> dict[str, Column]:
    genres = F.coalesce("genres", F.array().cast("array<string>"))
    return {
        "days": F.coalesce(days_since(F.col("date_created"), as_of), F.lit(0)),
        "genres_text": F.when(F.size(genres) > 0, F.array_join(genres, ", ")).otherwise(F.lit(NO_GENRE)),
        "primary_genre": F.coalesce(F.get(genres, F.lit(0)), F.lit(NO_GENRE)),
    }


def size_gb(size: Column) -> Column:
    return F.bround(size / F.lit(float(1024**3)), 2)


def movie_facts(movies: DataFrame, played: DataFrame, rules: DataFrame, as_of: dt.date | str) -> DataFrame:
    """One row per movie: size, language, age in days, decade, genre, library by the folder ``rules``, played."""
    audio = first_stream(F.col("media_streams"), "Audio")
    year = F.nullif("production_year", F.lit(0))
    size = F.coalesce("size", F.lit(0))
    facts = with_library(movies, rules).select(
        "item_id", "name", F.coalesce(year, F.lit(0)).alias("year"),
        F.coalesce(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")), F.lit("Unknown")).alias("decade"),
        F.coalesce(first_non_blank(audio["display_language"], audio["language"]), F.lit("Unknown")).alias("language"),
        size.alias("size"), size_gb(size).alias("size_gb"), "path", "guessed_library",
        *[c.alias(n) for n, c in _common_facts(as_of).items()],
    )
    flags = played.select("item_id").withColumn("_played", F.lit(True))
    return facts.join(flags, "item_id", "left").withColumn("played", F.coalesce("_played", F.lit(False))).drop("_played")


def series_facts(series: DataFrame, episodes: DataFrame, user_data: DataFrame, users: DataFrame, rules: DataFrame,
                 as_of: dt.date | str) -> DataFrame:
    """One row per series: episodes, played episodes, share, watchers, age in days, library by the folder ``rules``."""
    flags = played_items(user_data).withColumn("_played", F.lit(True))
    counts = (
        episodes.where(non_blank(F.col("series_id"))).select("item_id", "series_id").join(flags, "item_id", "left")
        .groupBy("series_id").agg(F.count("*").alias("total"), F.count("_played").alias("played_n"))
    )
    pairs = played_series(user_data, episodes).join(users.select("user_id", "user_name"), "user_id")
    watchers = pairs.select("series_id", "user_name").distinct()
    names = joined_top(watchers, ["series_id"], [F.col("user_name")], 5, "user_name", ", ", "watchers")
    n_watchers = watchers.groupBy("series_id").agg(F.count("*").alias("n_watchers"))
    total, played_n = F.coalesce("total", F.lit(0)), F.coalesce("played_n", F.lit(0))
    share = F.coalesce(F.bround(played_n / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0))
    rows = with_library(series, rules).withColumn("series_id", F.col("item_id"))
    for side in (counts, names, n_watchers):
        rows = rows.join(side, "series_id", "left")
    return rows.select(
        "item_id", "name", F.coalesce("production_year", F.lit(0)).alias("year"),
        total.alias("total_episodes"), played_n.alias("played_episodes"), share.alias("pct_watched"),
        (played_n > 0).alias("played"), F.coalesce("watchers", F.lit("")).alias("watchers"),
        F.coalesce("n_watchers", F.lit(0)).alias("n_watchers"), "guessed_library",
        *[c.alias(n) for n, c in _common_facts(as_of).items()],
    )


def _pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.bround(part / F.nullif(whole, F.lit(0)) * 100, 1), F.lit(0.0))


def utilisation_overview(movies: DataFrame, series: DataFrame) -> DataFrame:
    """Three rows: totals, unplayed counts and shares of movies, series and episodes."""
    m = movies.agg(F.count("*").alias("total"), F.count_if(~F.col("played")).alias("unplayed")).withColumn("kind", F.lit("Movies"))
    s = series.agg(
        F.count("*").alias("series"), F.count_if(~F.col("played")).alias("series_unplayed"),
        F.coalesce(F.sum("total_episodes"), F.lit(0)).alias("episodes"),
        F.coalesce(F.sum(F.col("total_episodes") - F.col("played_episodes")), F.lit(0)).alias("episodes_unplayed"),
    ).selectExpr("stack(2, 'Series', series, series_unplayed, 'Episodes', episodes, episodes_unplayed) AS (kind, total, unplayed)")
    return m.select("kind", "total", "unplayed").unionByName(s).withColumn("pct_unplayed", _pct(F.col("unplayed"), F.col("total")))


def unplayed_storage(movies: DataFrame) -> DataFrame:
    """Bytes of unplayed movies, in total and in TB."""
    size = F.coalesce(F.sum(F.when(~F.col("played"), F.col("size"))), F.lit(0))
    return movies.agg(size.alias("bytes")).withColumn("tb", F.bround(F.col("bytes") / F.lit(float(1024**4)), 1))


def by_library(movies: DataFrame, series: DataFrame) -> DataFrame:
    """Per guessed library the totals, unplayed counts, shares and sizes."""
    unplayed = ~F.col("played")
    m = movies.groupBy(F.col("guessed_library").alias("library")).agg(
        F.count("*").alias("movies"), F.count_if(unplayed).alias("movies_unplayed"),
        F.sum("size").alias("bytes"), F.sum(F.when(unplayed, F.col("size")).otherwise(0)).alias("bytes_unplayed"),
    )
    s = series.groupBy(F.col("guessed_library").alias("library")).agg(
        F.count("*").alias("series"), F.count_if(unplayed).alias("series_unplayed"))
    joined = m.join(s, "library", "full_outer").fillna(0)
    return joined.select("*", _pct(F.col("movies_unplayed"), F.col("movies")).alias("pct_movies"),
                         _pct(F.col("series_unplayed"), F.col("series")).alias("pct_series"))


def unplayed_movies(movies: DataFrame, min_gb: float = 0.0, genre: str | None = None, decade: str | None = None) -> DataFrame:
    rows = movies.where(~F.col("played") & (F.col("size_gb") >= min_gb))
    if genre is not None:
        rows = rows.where(F.col("primary_genre") == genre)
    return rows if decade is None else rows.where(F.col("decade") == decade)


def biggest_unplayed(rows: DataFrame, top: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("size"), "item_id").limit(top)


def by_language(movies: DataFrame, top: int = 15) -> DataFrame:
    """Per audio language the played and unplayed movies; commonest languages first."""
    counts = movies.groupBy("language").agg(
        F.count("*").alias("total"), F.count_if("played").alias("n_played"))
    counts = counts.withColumn("n_unplayed", F.col("total") - F.col("n_played"))
    return counts.withColumn("pct_unplayed", _pct(F.col("n_unplayed"), F.col("total"))).orderBy(F.desc("total"), "language").limit(top)


def forgotten(rows: DataFrame, top: int = 200) -> DataFrame:
    """Unplayed titles that have been in the library longest."""
    return rows.where(~F.col("played")).orderBy(F.desc("days"), "item_id").limit(top)


def forgotten_stats(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("played")).agg(
        F.avg("days").alias("avg_days"), F.max("days").alias("max_days"),
        F.count_if(F.col("days") > 365).alias("over_1y"), F.count_if(F.col("days") > 730).alias("over_2y"))


def days_histogram(rows: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of unplayed titles per bin of days, over their own range."""
    counts, low, high = counts_with_range(rows.where(~F.col("played")), "days")
    place = F.floor((F.col("days") - low) * F.lit(bins) / F.nullif(high - low, F.lit(0))) + 1
    place = F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("int")
    return counts.select(place.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n"))


def abandoned(series: DataFrame) -> DataFrame:
    """Series of five episodes or more that someone began and nobody half finished."""
    return series.where("played_episodes > 0 AND pct_watched < 50 AND total_episodes >= 5")


def abandonment_rate(series: DataFrame) -> DataFrame:
    given_up = F.count_if(F.expr("played_episodes > 0 AND pct_watched < 50 AND total_episodes >= 5"))
    counts = series.agg(given_up.alias("abandoned"), F.count_if(F.col("played_episodes") > 0).alias("started"))
    return counts.withColumn("rate_pct", _pct(F.col("abandoned"), F.col("started")))
