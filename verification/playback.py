"""Queries of the playback and the utilisation family."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reelwright.operators import playback as P
from reelwright.operators import utilisation as U
from reelwright.sources.catalogue import scan_playback
from verification.bridge import AS_OF, Bridge
from verification.registry import fragment, query

DAY = dt.date(2024, 1, 2)
YEARS = (2022, 2023, 2024)

# The oracle pairs by one running count of stops per user and item.
fragment("o_blocks", """SELECT *, coalesce(sum((type = 'playback.stop')::int) OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk,
sum((type = 'playback.stop')::int) OVER (PARTITION BY user_id, item_id) AS stops FROM b_playback""")
fragment("o_raw_sessions", """SELECT user_id, item_id, min(ts) FILTER (type = 'playback.start') AS start_ts, arg_min(name, (ts, event_id)) FILTER (type = 'playback.start') AS title,
arg_min(event_id, (ts, event_id)) FILTER (type = 'playback.start') AS event_id, min(ts) FILTER (type = 'playback.stop') AS stop_ts FROM o_blocks WHERE blk < stops
GROUP BY user_id, item_id, blk HAVING count(*) FILTER (type = 'playback.start') > 0
UNION ALL SELECT user_id, item_id, ts, name, event_id, NULL FROM o_blocks WHERE blk = stops AND type = 'playback.start'""")
fragment("o_sessions", """SELECT s.*, coalesce(user_name, 'Unknown') AS user, year(start_ts) AS year, month(start_ts) AS month, hour(start_ts) AS hour, dayname(start_ts) AS weekday,
strftime(start_ts, '%Y-%m-%d') AS date, CASE WHEN regexp_matches(title, '(?i)S\\d+,?\\s*Ep?\\d+') THEN 'Episode' ELSE 'Movie' END AS content_type,
CASE WHEN d BETWEEN 10 AND 28800 THEN round_even(cast(d / 60 AS decimal(38, 12)), 1)::double END AS duration_min,
strftime(start_ts, '%Y-%m-%d') <= year(start_ts) || '-01-02' AS ytd
FROM (SELECT *, (epoch_us(stop_ts) - epoch_us(start_ts)) / 1e6 AS d FROM o_raw_sessions) s LEFT JOIN b_users USING (user_id)""")


def _h(cond: str = "true") -> str:
    return f"round_even(cast(coalesce(sum(duration_min::decimal(20,1)) FILTER ({cond}), 0) / 60 AS decimal(38, 12)), 1)::double"


def _sessions(b: Bridge):
    return P.playback_sessions(scan_playback(b.activity), b.users)


@query("scan_playback", "SELECT event_id, type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, item_id, name FROM b_playback")
def _(b: Bridge):
    return scan_playback(b.activity).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("playback_sessions", """SELECT user_id, item_id, event_id, title, strftime(start_ts, '%Y-%m-%d %H:%M:%S.%f') AS start_ts, duration_min, content_type,
year, month, hour, weekday, date, user FROM o_sessions""")
def _(b: Bridge):
    return _sessions(b).select(
        "user_id", "item_id", "event_id", "title", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_ts"),
        "duration_min", "content_type", "year", "month", "hour", "weekday", "date", "user")


@query("yoy_overview", f"""SELECT y.*, coalesce(round_even(cast((y.hours_ytd - p.hours_ytd) / nullif(p.hours_ytd, 0) * 100 AS decimal(38, 12)), 1)::double, 0) AS growth_pct FROM
(SELECT year, count(*) AS sessions, count(*) FILTER (ytd) AS sessions_ytd, {_h()} AS hours, {_h('ytd')} AS hours_ytd, count(DISTINCT item_id) AS titles,
count(DISTINCT item_id) FILTER (ytd) AS titles_ytd, count(DISTINCT user) AS users, count(DISTINCT user) FILTER (ytd) AS users_ytd,
round_even(cast(coalesce(avg(duration_min::decimal(20,1)), 0) AS decimal(38, 12)), 1)::double AS avg_session, count(*) FILTER (ytd AND content_type = 'Movie') AS movies_ytd,
count(*) FILTER (ytd AND content_type = 'Episode') AS episodes_ytd FROM o_sessions GROUP BY year) y LEFT JOIN
(SELECT year + 1 AS year, {_h('ytd')} AS hours_ytd FROM o_sessions GROUP BY year) p ON p.year = y.year""")
def _(b: Bridge):
    return P.yoy_overview(_sessions(b), DAY)


_PIV = ", ".join(f"{_h(f'year = {y}')} AS \"{y}_hours\", count(duration_min) FILTER (year = {y}) AS \"{y}_sessions\"" for y in YEARS)


@query("monthly_pivot", f"SELECT month, {_PIV} FROM o_sessions WHERE duration_min IS NOT NULL GROUP BY month")
def _(b: Bridge):
    return P.monthly_pivot(_sessions(b), YEARS)


@query("user_yoy", f"""SELECT *, round_even(cast(hours_now - hours_then AS decimal(38, 12)), 1)::double AS hours_diff FROM (SELECT user, {_h('ytd AND year = 2024')} AS hours_now, {_h('ytd AND year = 2023')} AS hours_then,
count(*) FILTER (ytd AND year = 2024) AS sessions_now, count(*) FILTER (ytd AND year = 2023) AS sessions_then, count(DISTINCT item_id) FILTER (ytd AND year = 2024) AS titles_now
FROM o_sessions GROUP BY user HAVING count(duration_min) FILTER (ytd AND year IN (2023, 2024)) > 0) ORDER BY hours_now DESC, user LIMIT 15""")
def _(b: Bridge):
    return P.user_yoy(_sessions(b), DAY, 15)


@query("content_split", f"""SELECT *, coalesce(round_even(cast(movie_hours / nullif(movie_hours + episode_hours, 0) * 100 AS decimal(38, 12)), 0)::int, 0) AS movie_pct FROM
(SELECT year, count(*) FILTER (content_type = 'Movie') AS movie_sessions, count(*) FILTER (content_type = 'Episode') AS episode_sessions,
{_h("content_type = 'Movie'")} AS movie_hours, {_h("content_type = 'Episode'")} AS episode_hours FROM o_sessions WHERE ytd GROUP BY year)""")
def _(b: Bridge):
    return P.content_split(_sessions(b), DAY)


@query("peak_days", f"""SELECT date, count(*) AS sessions, {_h()} AS hours, count(DISTINCT user) AS users, count(DISTINCT item_id) AS titles FROM o_sessions
WHERE year = 2024 AND duration_min IS NOT NULL GROUP BY date ORDER BY hours DESC, date LIMIT 2""")
def _(b: Bridge):
    return P.peak_days(_sessions(b), 2024, 2)


@query("weekday_avg", """SELECT i::int AS day_index, d AS weekday, round_even(cast(h AS decimal(38, 12)), 1)::double AS total_hours, round_even(cast(h / n_days AS decimal(38, 12)), 1)::double AS avg_hours,
n AS sessions, round_even(cast(n / n_days AS decimal(38, 12)), 1)::double AS avg_sessions FROM (SELECT i, d, coalesce(m, 0)::double / 60 AS h, coalesce(n, 0) AS n, coalesce(n_days, 1) AS n_days FROM
(SELECT unnest(range(7)) AS i, unnest(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']) AS d) LEFT JOIN
(SELECT dayname(x) AS d, count(*) AS n_days FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-11', INTERVAL 1 DAY)) AS x) GROUP BY 1) USING (d) LEFT JOIN
(SELECT weekday AS d, sum(duration_min::decimal(20,1)) AS m, count(*) AS n FROM o_sessions WHERE year = 2024 AND duration_min IS NOT NULL GROUP BY 1) USING (d))""")
def _(b: Bridge):
    return P.weekday_avg(_sessions(b), dt.date(2024, 1, 10))


@query("hourly_by_year", "SELECT h::int AS hour, " + ", ".join(f"{_h(f'year = {y} AND ytd')} AS \"{y}\"" for y in YEARS) +
       " FROM (SELECT unnest(range(24)) AS h) LEFT JOIN o_sessions ON hour = h GROUP BY h")
def _(b: Bridge):
    return P.hourly_by_year(_sessions(b), DAY, YEARS)


# ------------------------------------------------------------------------ utilisation
_LIB = "coalesce((SELECT arg_min(r.library, (r.priority, r.library)) FROM b_folder_rules r WHERE contains({0}, r.folders)), 'Other')"
_DAYS = "coalesce(date_diff('day', try_cast(left({0}, 10) AS date), DATE '2002-01-01'), 0)"
_PCT = "coalesce(round_even(cast({0} / nullif({1}, 0) * 100 AS decimal(38, 12)), 1)::double, 0)"
fragment("o_folder_library", f"SELECT folder, {_LIB.format('folder_path')} AS library FROM (SELECT DISTINCT folder, folder || '/' AS folder_path FROM b_items)")
fragment("o_movie_facts", f"""SELECT item_id, name, coalesce(production_year, 0) AS year, CASE WHEN production_year IS NULL THEN 'Unknown' ELSE (production_year // 10 * 10) || 's' END AS decade,
coalesce(lang1, 'Unknown') AS language, coalesce(size, 0) AS size, round_even(cast(coalesce(size, 0) / 1073741824e0 AS decimal(38, 12)), 2)::double AS size_gb, {_DAYS.format('date_created')} AS days,
CASE WHEN genre1 IS NULL AND genre2 IS NULL THEN '(No genre)' ELSE concat_ws(', ', genre1, genre2) END AS genres_text, coalesce(genre1, genre2, '(No genre)') AS primary_genre,
l.library, item_id IN (SELECT item_id FROM b_user_data WHERE played) AS played FROM b_items JOIN o_folder_library l USING (folder) WHERE type = 'Movie'""")
fragment("o_watch", """SELECT DISTINCT series_id, user_name FROM b_user_data u JOIN b_items USING (item_id) JOIN b_users USING (user_id) WHERE u.played AND series_id IS NOT NULL""")
fragment("o_series_facts", f"""SELECT s.item_id, s.name, total_episodes, played_episodes, {_PCT.format('played_episodes', 'total_episodes')} AS pct_watched, played_episodes > 0 AS played,
coalesce(watchers, '') AS watchers, coalesce(n_watchers, 0) AS n_watchers, {_DAYS.format("(first_year || '-01-01')")} AS days, {_LIB.format("s.path")} AS library FROM b_series s JOIN
(SELECT series_id, count(*) AS total_episodes, count(*) FILTER (item_id IN (SELECT item_id FROM b_user_data WHERE played)) AS played_episodes FROM b_items WHERE series_id IS NOT NULL GROUP BY 1) e ON e.series_id = s.item_id
LEFT JOIN (SELECT series_id, array_to_string(list(user_name ORDER BY user_name)[1:5], ', ') AS watchers, count(*) AS n_watchers FROM o_watch GROUP BY 1) w ON w.series_id = s.item_id""")


def _movies(b: Bridge):
    return U.movie_facts(b.items.where("type = 'Movie'"), U.played_items(b.user_data), b.folder_rules, AS_OF)


def _series(b: Bridge):
    return U.series_facts(b.series, b.items.where("type = 'Episode'"), b.user_data, b.users, b.folder_rules, AS_OF)


@query("played_sets", """SELECT 'item' AS kind, item_id AS id, '' AS who FROM (SELECT DISTINCT item_id FROM b_user_data WHERE played) UNION ALL
SELECT DISTINCT 'series', series_id, user_id FROM b_user_data u JOIN b_items USING (item_id) WHERE u.played AND series_id IS NOT NULL""")
def _(b: Bridge):
    items = U.played_items(b.user_data).select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.lit("").alias("who"))
    series = U.played_series(b.user_data, b.items).select(F.lit("series").alias("kind"), F.col("series_id").alias("id"), F.col("user_id").alias("who"))
    return items.unionByName(series)


@query("movie_facts", "SELECT item_id, year, decade, language, size_gb, days, genres_text, primary_genre, library, played FROM o_movie_facts")
def _(b: Bridge):
    return _movies(b).select("item_id", "year", "decade", "language", "size_gb", "days", "genres_text", "primary_genre",
                             F.col("guessed_library").alias("library"), "played")


@query("series_facts", "SELECT item_id, total_episodes, played_episodes, pct_watched, played, watchers, n_watchers, days, library FROM o_series_facts")
def _(b: Bridge):
    return _series(b).select("item_id", "total_episodes", "played_episodes", "pct_watched", "played", "watchers", "n_watchers", "days",
                             F.col("guessed_library").alias("library"))


@query("utilisation_overview", f"""SELECT kind, total, unplayed, {_PCT.format('unplayed', 'total')} AS pct_unplayed FROM (SELECT 'Movies' AS kind, count(*) AS total, count(*) FILTER (NOT played) AS unplayed FROM o_movie_facts
UNION ALL SELECT 'Series', count(*), count(*) FILTER (NOT played) FROM o_series_facts UNION ALL SELECT 'Episodes', sum(total_episodes)::bigint, sum(total_episodes - played_episodes)::bigint FROM o_series_facts)""")
def _(b: Bridge):
    return U.utilisation_overview(_movies(b), _series(b))


@query("unplayed_storage", "SELECT sum(size)::bigint AS bytes, round_even(cast(sum(size)::bigint / 1099511627776e0 AS decimal(38, 12)), 1)::double AS tb FROM o_movie_facts WHERE NOT played")
def _(b: Bridge):
    return U.unplayed_storage(_movies(b))


@query("by_library", f"""SELECT *, {_PCT.format('movies_unplayed', 'movies')} AS pct_movies, {_PCT.format('series_unplayed', 'series')} AS pct_series FROM (SELECT coalesce(m.library, s.library) AS library,
coalesce(movies, 0) AS movies, coalesce(movies_unplayed, 0) AS movies_unplayed, coalesce(bytes, 0) AS bytes, coalesce(bytes_unplayed, 0) AS bytes_unplayed, coalesce(series, 0) AS series, coalesce(series_unplayed, 0) AS series_unplayed FROM
(SELECT library, count(*) AS movies, count(*) FILTER (NOT played) AS movies_unplayed, sum(size)::bigint AS bytes, coalesce(sum(size) FILTER (NOT played), 0)::bigint AS bytes_unplayed FROM o_movie_facts GROUP BY 1) m
FULL JOIN (SELECT library, count(*) AS series, count(*) FILTER (NOT played) AS series_unplayed FROM o_series_facts GROUP BY 1) s ON m.library = s.library)""")
def _(b: Bridge):
    return U.by_library(_movies(b), _series(b))


@query("biggest_unplayed", "SELECT item_id, size, size_gb, primary_genre, decade FROM o_movie_facts WHERE NOT played AND size_gb >= 2 AND decade = '1990s' ORDER BY size DESC, item_id LIMIT 20")
def _(b: Bridge):
    return U.biggest_unplayed(U.unplayed_movies(_movies(b), 2.0, decade="1990s")).select("item_id", "size", "size_gb", "primary_genre", "decade")


@query("by_language", f"""SELECT language, total, n_played, total - n_played AS n_unplayed, {_PCT.format('(total - n_played)', 'total')} AS pct_unplayed FROM
(SELECT language, count(*) AS total, count(*) FILTER (played) AS n_played FROM o_movie_facts GROUP BY 1 ORDER BY total DESC, language LIMIT 15)""")
def _(b: Bridge):
    return U.by_language(_movies(b))


@query("forgotten", "SELECT item_id, days FROM o_movie_facts WHERE NOT played ORDER BY days DESC, item_id LIMIT 200")
def _(b: Bridge):
    return U.forgotten(_movies(b)).select("item_id", "days")


@query("forgotten_stats", "SELECT round(avg(days), 6) AS avg_days, max(days) AS max_days, count(*) FILTER (days > 365) AS over_1y, count(*) FILTER (days > 730) AS over_2y FROM o_movie_facts WHERE NOT played")
def _(b: Bridge):
    return U.forgotten_stats(_movies(b)).withColumn("avg_days", F.round("avg_days", 6))


@query("days_histogram", """SELECT least(floor((days - lo) * 30 / (hi - lo)) + 1, 30)::int AS bin, count(*) AS n FROM o_movie_facts, (SELECT min(days) AS lo, max(days) AS hi FROM o_movie_facts WHERE NOT played)
WHERE NOT played GROUP BY 1""")
def _(b: Bridge):
    return U.days_histogram(_movies(b))


@query("abandoned", "SELECT item_id, total_episodes, played_episodes, pct_watched FROM o_series_facts WHERE played_episodes > 0 AND pct_watched < 50 AND total_episodes >= 5")
def _(b: Bridge):
    return U.abandoned(_series(b)).select("item_id", "total_episodes", "played_episodes", "pct_watched")


@query("abandonment_rate", f"""SELECT *, {_PCT.format('abandoned', 'started')} AS rate_pct FROM (SELECT count(*) FILTER (played_episodes > 0 AND pct_watched < 50 AND total_episodes >= 5) AS abandoned,
count(*) FILTER (played_episodes > 0) AS started FROM o_series_facts)""")
def _(b: Bridge):
    return U.abandonment_rate(_series(b))
