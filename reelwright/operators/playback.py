"""Playback sessions from start and stop events, and year-over-year figures over them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright import constants as K

CHUNK_SECONDS = 3600
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def session_minutes(start: Column, stop: Column) -> Column:
    """Minutes between start and stop with one decimal; null outside 10 seconds to 8 hours."""
    seconds = (F.unix_micros(stop) - F.unix_micros(start)) / F.lit(1e6)
    plausible = seconds.between(K.MIN_SESSION_SECONDS, K.MAX_SESSION_SECONDS)
    return F.when(plausible, F.bround(seconds / F.lit(60.0), 1))


def playback_sessions(events: DataFrame, users: DataFrame | None = None,
                      chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Pairs each first start with the next stop of the same user and item.

    The starts between two stops form one block; a start after the last stop stands alone
    without a duration. Blocks are numbered by the stops before them: within a chunk of time by
    a window, across chunks by adding the stops of the earlier chunks. So one busy user and
    item is ordered by many tasks, and only its chunk totals meet in one.
    """
    key = ["user_id", "item_id"]
    stop = F.col("type") == K.PLAYBACK_STOP
    rows = events.where(F.col("type").isin(K.PLAYBACK_START, K.PLAYBACK_STOP) & F.col("ts").isNotNull()).select(
        F.coalesce("user_id", F.lit("")).alias("user_id"), F.coalesce("item_id", F.lit("")).alias("item_id"),
        "ts", "event_id", "name", stop.cast("bigint").alias("is_stop"),
        F.floor(F.unix_seconds("ts") / chunk_seconds).alias("chunk"),
    )
    inside = Window.partitionBy(*key, "chunk").orderBy("ts", "event_id")
    before_row = F.sum("is_stop").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ordered = rows.withColumn("block", F.coalesce(before_row, F.lit(0)))
    chunks = rows.groupBy(*key, "chunk").agg(F.sum("is_stop").alias("stops"))
    across = Window.partitionBy(*key)
    earlier = F.sum("stops").over(across.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select(
        *key, "chunk", F.coalesce(earlier, F.lit(0)).alias("earlier"), F.sum("stops").over(across).alias("all_stops"))
    placed = ordered.join(chunks, [*key, "chunk"]).withColumn("block", F.col("block") + F.col("earlier"))
    alone = F.when(F.col("block") == F.col("all_stops"), F.col("event_id"))
    start = F.when(F.col("is_stop") == 0, F.struct("ts", "event_id", "name"))
    pairs = placed.groupBy(*key, "block", alone.alias("alone")).agg(
        F.min(start).alias("start"), F.min(F.when(F.col("is_stop") == 1, F.col("ts"))).alias("stop_ts")
    ).where("start IS NOT NULL")
    sessions = pairs.select(
        *key, F.col("start.event_id").alias("event_id"), F.col("start.ts").alias("start_ts"), "stop_ts",
        F.col("start.name").alias("title"),
    )
    return describe_sessions(sessions, users)


def describe_sessions(sessions: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Adds duration, content type, calendar fields and the user's name."""
    ts = F.col("start_ts")
    described = sessions.select(
        "*",
        session_minutes(ts, F.col("stop_ts")).alias("duration_min"),
        F.when(F.col("title").rlike(K.EPISODE_NAME_PATTERN), "Episode").otherwise("Movie").alias("content_type"),
        F.year(ts).alias("year"), F.month(ts).alias("month"), F.hour(ts).alias("hour"),
        F.date_format(ts, "EEEE").alias("weekday"), F.date_format(ts, "yyyy-MM-dd").alias("date"),
    )
    if users is None:
        return described
    names = users.select("user_id", F.col("user_name").alias("user"))
    return described.join(names, "user_id", "left").withColumn("user", F.coalesce("user", F.lit("Unknown")))


# --------------------------------------------------------------------------- figures


def hours(minutes: Column) -> Column:
    """Sum of one-decimal minutes as hours with one decimal; summed exactly, so order is moot."""
    total = F.coalesce(F.sum(minutes.cast("decimal(20,1)")), F.lit(0).cast("decimal(20,1)"))
    return F.bround(total / F.lit(60), 1).cast("double")


def in_period(as_of: dt.date) -> Column:
    """Whether a session's day is not after the reference day, in the session's own year."""
    cutoff = F.concat(F.col("year").cast("string"), F.lit(f"-{as_of.month:02d}-{as_of.day:02d}"))
    return F.col("date") <= cutoff


def yoy_overview(sessions: DataFrame, as_of: dt.date) -> DataFrame:
    """Per year: figures of the whole year and of the same period, and growth of its hours."""
    ytd = in_period(as_of)
    years = sessions.groupBy("year").agg(
        F.count("*").alias("sessions"), F.count_if(ytd).alias("sessions_ytd"),
        hours(F.col("duration_min")).alias("hours"),
        hours(F.when(ytd, F.col("duration_min"))).alias("hours_ytd"),
        F.countDistinct("item_id").alias("titles"), F.countDistinct(F.when(ytd, F.col("item_id"))).alias("titles_ytd"),
        F.countDistinct("user").alias("users"), F.countDistinct(F.when(ytd, F.col("user"))).alias("users_ytd"),
        F.bround(F.coalesce(F.avg(F.col("duration_min").cast("decimal(20,1)")), F.lit(0)), 1).cast("double").alias("avg_session"),
        F.count_if(ytd & (F.col("content_type") == "Movie")).alias("movies_ytd"),
        F.count_if(ytd & (F.col("content_type") == "Episode")).alias("episodes_ytd"),
    )
    previous = years.select((F.col("year") + 1).alias("year"), F.col("hours_ytd").alias("previous"))
    growth = F.bround((F.col("hours_ytd") - F.col("previous")) / F.nullif("previous", F.lit(0.0)) * 100, 1)
    return years.join(previous, "year", "left").withColumn("growth_pct", F.coalesce(growth, F.lit(0.0))).drop("previous")


def monthly_pivot(sessions: DataFrame, years: Sequence[int]) -> DataFrame:
    """Hours and measured sessions per month, one pair of columns per year, zeros filled."""
    watched = sessions.where("duration_min IS NOT NULL")
    table = watched.groupBy("month").pivot("year", list(years)).agg(
        hours(F.col("duration_min")).alias("hours"), F.count("duration_min").alias("sessions"))
    return table.fillna(0)


def user_yoy(sessions: DataFrame, as_of: dt.date, top: int | None = None) -> DataFrame:
    """Per user the period's hours, sessions and titles against the year before."""
    ytd = in_period(as_of)
    now, then = ytd & (F.col("year") == as_of.year), ytd & (F.col("year") == as_of.year - 1)
    minutes = F.col("duration_min")
    per_user = sessions.groupBy("user").agg(
        hours(F.when(now, minutes)).alias("hours_now"), hours(F.when(then, minutes)).alias("hours_then"),
        F.count_if(now).alias("sessions_now"), F.count_if(then).alias("sessions_then"),
        F.countDistinct(F.when(now, F.col("item_id"))).alias("titles_now"),
        F.count_if((now | then) & minutes.isNotNull()).alias("_measured"),
    ).where("_measured > 0").drop("_measured")
    rows = per_user.withColumn("hours_diff", F.bround(F.col("hours_now") - F.col("hours_then"), 1))
    ordered = rows.orderBy(F.desc("hours_now"), "user")
    return ordered if top is None else ordered.limit(top)


def content_split(sessions: DataFrame, as_of: dt.date) -> DataFrame:
    """Per year the period's movie and episode sessions and hours, and the movie share."""
    rows = sessions.where(in_period(as_of))
    movie = F.col("content_type") == "Movie"
    minutes = F.col("duration_min")
    split = rows.groupBy("year").agg(
        F.count_if(movie).alias("movie_sessions"), F.count_if(~movie).alias("episode_sessions"),
        hours(F.when(movie, minutes)).alias("movie_hours"), hours(F.when(~movie, minutes)).alias("episode_hours"),
    )
    total = F.col("movie_hours") + F.col("episode_hours")
    share = F.bround(F.col("movie_hours") / F.nullif(total, F.lit(0.0)) * 100, 0).cast("int")
    return split.withColumn("movie_pct", F.coalesce(share, F.lit(0)))


def peak_days(sessions: DataFrame, year: int, top: int = 20) -> DataFrame:
    """The days of a year with most hours watched."""
    watched = sessions.where((F.col("year") == year) & F.col("duration_min").isNotNull())
    days = watched.groupBy("date").agg(
        F.count("*").alias("sessions"), hours(F.col("duration_min")).alias("hours"),
        F.countDistinct("user").alias("users"), F.countDistinct("item_id").alias("titles"),
    )
    return days.orderBy(F.desc("hours"), "date").limit(top)


def weekday_avg(sessions: DataFrame, as_of: dt.date) -> DataFrame:
    """Totals per weekday of the year and averages over its weekdays so far; all seven rows."""
    spark = sessions.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(f"{as_of.year}-01-01").cast("date"), F.lit(str(as_of)).cast("date"))).alias("d"))
    seen = days.groupBy(F.date_format("d", "EEEE").alias("weekday")).agg(F.count("*").alias("n_days"))
    order = F.array(*[F.lit(d) for d in WEEKDAYS])
    names = spark.range(7).select(F.get(order, F.col("id").cast("int")).alias("weekday"), F.col("id").cast("int").alias("day_index"))
    watched = sessions.where((F.col("year") == as_of.year) & F.col("duration_min").isNotNull())
    totals = watched.groupBy("weekday").agg(
        F.sum(F.col("duration_min").cast("decimal(20,1)")).alias("minutes"), F.count("*").alias("n"))
    joined = names.join(seen, "weekday", "left").join(totals, "weekday", "left")
    n_days = F.coalesce("n_days", F.lit(1))
    spent = F.coalesce(F.col("minutes").cast("double"), F.lit(0.0)) / 60.0
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        "day_index", "weekday", F.bround(spent, 1).alias("total_hours"), F.bround(spent / n_days, 1).alias("avg_hours"),
        n.alias("sessions"), F.bround(n / n_days, 1).alias("avg_sessions"),
    )


def hourly_by_year(sessions: DataFrame, as_of: dt.date, years: Sequence[int]) -> DataFrame:
    """Hours watched per hour of day, one column per year; all 24 rows."""
    watched = sessions.where(F.col("duration_min").isNotNull() & in_period(as_of))
    table = watched.groupBy("hour").pivot("year", list(years)).agg(hours(F.col("duration_min")))
    clock = sessions.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return clock.join(table, "hour", "left").fillna(0.0)
