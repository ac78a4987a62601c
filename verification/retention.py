"""Queries of the retention family and of the display strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.functions import display
from reelwright.functions.dates import age_years
from reelwright.operators import retention as R
from verification.bridge import AS_OF, Bridge
from verification.registry import fragment, query

EXCLUDED = ("tt0000040", "5012", "900010", "33")
P = R.RetentionParams(as_of=AS_OF, excluded_provider_ids=EXCLUDED, min_age_years=1, masterpiece_only_after_years=6,
                      no_actor_protection_after_years=5, near_miss_count=200)
_EX = "('tt0000040', '5012', '900010', '33')"
FAVORITE_ACTORS = ("Actor 1", "Actor 2")

_AGE = "coalesce(date_diff('day', try_cast(left({0}, 10) AS date), DATE '2002-01-01') / 365.25e0, 0.0e0)"
_THR = "least(6.0e0 + (age - 1.0e0) * 0.5e0, 8.0e0)"
_EFF = ("coalesce((community_rating + critic_rating / 10.0e0) / 2.0e0, community_rating, critic_rating / 10.0e0, 0.0e0)")
fragment("o_status", """SELECT item_id, bool_or(played) AS played, bool_or(is_favorite OR position_ticks > 0) AS interested
FROM b_user_data GROUP BY item_id""")
fragment("o_movies", f"""SELECT * REPLACE (CASE WHEN age >= 6 AND stage = 'candidate' THEN 9.0e0 ELSE threshold END AS threshold) FROM
(SELECT *, CASE WHEN age < 1 THEN 'age_filtered' WHEN excluded THEN 'excluded_filtered' WHEN played THEN 'play_protected'
WHEN interested THEN 'interest_protected' WHEN contains(path, '/Dokumenty/') THEN 'path_protected'
WHEN age >= 6 AND effective >= 9 THEN 'rating_protected' WHEN age >= 6 THEN 'candidate'
WHEN age < 5 AND (actor1 IN ('Actor 1', 'Actor 2') OR actor2 IN ('Actor 1', 'Actor 2')) THEN 'actor_protected'
WHEN tmdbcollection IS NOT NULL THEN 'franchise_protected' WHEN effective >= threshold THEN 'rating_protected' ELSE 'candidate' END AS stage FROM
(SELECT *, {_THR} AS threshold FROM (SELECT i.*, played, interested, {_AGE.format('date_created')} AS age, {_EFF} AS effective,
coalesce(imdb IN {_EX}, false) OR coalesce(tmdb IN {_EX}, false) OR coalesce(tvdb IN {_EX}, false) OR coalesce(tmdbcollection IN {_EX}, false) AS excluded
FROM b_items i LEFT JOIN o_status USING (item_id) WHERE type = 'Movie')))""")
fragment("o_last_added", "SELECT series_id, max(date_created) AS last_added FROM b_items WHERE series_id IS NOT NULL AND date_created <> '' GROUP BY 1")
fragment("o_series_status", """SELECT u.item_id, bool_or(played) OR bool_or(coalesce(unplayed_item_count, n_orders) < n_orders) AS played,
bool_or(is_favorite) AS favorited FROM b_series_user_data u JOIN b_series USING (item_id) GROUP BY u.item_id""")
fragment("o_series_rows", f"""SELECT *, CASE WHEN age < 1 THEN 'stale_filtered' WHEN excluded THEN 'excluded_filtered' WHEN played THEN 'play_protected'
WHEN favorited THEN 'favorite_protected' WHEN contains(path, '/Dokumenty/') THEN 'path_protected' WHEN effective >= threshold THEN 'rating_protected'
ELSE 'candidate' END AS stage FROM (SELECT *, {_THR} AS threshold FROM (SELECT s.*, last_added, played, favorited,
{_AGE.format('last_added')} AS age, {_EFF} AS effective, coalesce(imdb IN {_EX}, false) OR coalesce(tmdb IN {_EX}, false) OR coalesce(tvdb IN {_EX}, false) AS excluded
FROM b_series s LEFT JOIN o_last_added ON series_id = s.item_id LEFT JOIN o_series_status st ON st.item_id = s.item_id))""")
_DAYS = """CASE WHEN effective < 9 THEN cast(trunc(greatest((least(CASE WHEN effective <= 8 THEN (effective - 6.0e0) / 0.5e0 + 1.0e0 END, 6.0e0) - age) * 365.25e0, 0.0e0)) AS int) END"""


def _movies(b: Bridge):
    favorites = b.spark.createDataFrame([(n,) for n in FAVORITE_ACTORS], "name string")
    return R.classify_movies(b.items.where("type = 'Movie'"), R.any_user_status(b.user_data), favorites, P)


def _series(b: Bridge):
    return R.classify_series(b.series, R.series_user_status(b.series_user_data, b.series),
                             R.last_episode_added(b.items), P)


@query("age_years", f"SELECT item_id, round({_AGE.format('date_created')}, 6) AS age FROM b_items")
def _(b: Bridge):
    return b.items.select("item_id", F.round(age_years(F.col("date_created"), AS_OF), 6).alias("age"))


@query("rating_threshold", f"""SELECT item_id, round(least(6.0e0 + (age - 3.0e0) * 0.5e0, 8.0e0), 6) AS threshold FROM
(SELECT item_id, {_AGE.format('date_created')} AS age FROM b_items)""")
def _(b: Bridge):
    p = R.RetentionParams(as_of=AS_OF)
    return b.items.select("item_id", F.round(R.rating_threshold(age_years(F.col("date_created"), AS_OF), p), 6).alias("threshold"))


@query("effective_rating", f"SELECT item_id, round({_EFF}, 6) AS rating FROM b_items")
def _(b: Bridge):
    return b.items.select("item_id", F.round(R.effective_rating(F.col("community_rating"), F.col("critic_rating")), 6).alias("rating"))


@query("protection_flags", f"""SELECT item_id, tmdbcollection IS NOT NULL AS franchise, contains(path, '/Dokumenty/') AS path_protected,
coalesce(imdb IN {_EX}, false) OR coalesce(tmdb IN {_EX}, false) OR coalesce(tvdb IN {_EX}, false) OR coalesce(tmdbcollection IN {_EX}, false) AS excluded,
CASE WHEN actor1 = actor2 THEN actor1 ELSE actor1 || ',' || actor2 END AS actors FROM b_items""")
def _(b: Bridge):
    return R.with_protection_flags(b.items, P).select(
        "item_id", "franchise", "path_protected", "excluded", F.array_join(R.actor_names(F.col("people")), ",").alias("actors"))


@query("favorite_people", """SELECT name FROM (SELECT name, count(*) AS n FROM (SELECT unnest([actor1, actor2]) AS name FROM b_items
WHERE type = 'Movie' AND item_id IN (SELECT item_id FROM b_user_data WHERE user_id = '3' AND played)) GROUP BY name)
ORDER BY n DESC, name LIMIT 15""")
def _(b: Bridge):
    nobody = b.user_data.where("user_id = 'nobody'").select(F.col("item_id").alias("name"))
    plays = b.user_data.where("user_id = '3' AND played")
    return R.favorite_people(nobody, b.items, plays, R.RetentionParams(as_of=AS_OF, top_actors=15))


@query("any_user_status", "SELECT * FROM o_status")
def _(b: Bridge):
    return R.any_user_status(b.user_data)


@query("series_user_status", "SELECT * FROM o_series_status")
def _(b: Bridge):
    return R.series_user_status(b.series_user_data, b.series)


@query("last_episode_added", "SELECT * FROM o_last_added")
def _(b: Bridge):
    return R.last_episode_added(b.items)


@query("series_sizes", """SELECT series_id, cast(sum(coalesce(size, 0)) as bigint) AS size_bytes FROM b_items WHERE series_id IN
(SELECT item_id FROM o_series_rows WHERE stage IN ('candidate', 'rating_protected')) GROUP BY 1""")
def _(b: Bridge):
    wanted = _series(b).where("stage IN ('candidate', 'rating_protected')")
    return R.series_sizes(b.items, wanted)


@query("movie_cleanup", """SELECT item_id, stage, round(age, 6) AS age, round(threshold, 6) AS threshold, round(effective, 6) AS effective FROM o_movies""")
def _(b: Bridge):
    return _movies(b).select("item_id", "stage", F.round("age", 6).alias("age"), F.round("threshold", 6).alias("threshold"),
                             F.round("effective", 6).alias("effective"))


@query("series_cleanup", """SELECT item_id, stage, last_added, round(age, 6) AS stale_years, round(threshold, 6) AS threshold FROM o_series_rows""")
def _(b: Bridge):
    return _series(b).select("item_id", "stage", "last_added", F.round("age", 6).alias("stale_years"),
                             F.round("threshold", 6).alias("threshold"))


def _funnel_sql(table: str, stages) -> str:
    counts = ", ".join(f"count(*) FILTER (stage = '{s}') AS {s}" for s in stages)
    return f"SELECT count(*) AS total_analyzed, {counts} FROM {table}"


@query("cleanup_funnel", _funnel_sql("o_movies", R.MOVIE_STAGES))
def _(b: Bridge):
    return R.cleanup_funnel(_movies(b), R.MOVIE_STAGES)


@query("cleanup_funnel_series", _funnel_sql("o_series_rows", R.SERIES_STAGES))
def _(b: Bridge):
    return R.cleanup_funnel(_series(b), R.SERIES_STAGES)


@query("near_miss", f"""SELECT item_id, days_left FROM (SELECT item_id, {_DAYS} AS days_left FROM o_movies WHERE stage = 'rating_protected')
ORDER BY days_left ASC NULLS LAST, item_id LIMIT 200""")
def _(b: Bridge):
    return R.near_miss(_movies(b), P).select("item_id", "days_left")


@query("reclaimable_size", """SELECT count(*) AS n_candidates, cast(sum(coalesce(size, 0)) as bigint) AS size_bytes FROM o_movies WHERE stage = 'candidate'""")
def _(b: Bridge):
    return R.reclaimable_size(R.candidates(_movies(b)))


# ----------------------------------------------------------------------- display text
@query("format_rating", """SELECT item_id, CASE WHEN community_rating IS NOT NULL AND critic_rating IS NOT NULL THEN printf('%.1f/%.1f', community_rating, critic_rating / 10)
WHEN community_rating IS NOT NULL THEN printf('%.1f', community_rating) WHEN critic_rating IS NOT NULL THEN printf('RT:%.1f', critic_rating / 10) ELSE 'none' END AS rating FROM b_items""")
def _(b: Bridge):
    return b.items.select("item_id", display.format_rating(F.col("community_rating"), F.col("critic_rating")).alias("rating"))


@query("format_days_left", f"""SELECT item_id, CASE WHEN d IS NULL THEN 'never' WHEN d = 0 THEN 'now' WHEN d < 30 THEN d || 'd' WHEN d < 365 THEN (d // 30) || 'mo'
ELSE printf('%.1fyr', d / 365.25e0) END AS label FROM (SELECT item_id, {_DAYS} AS d FROM o_movies WHERE stage = 'rating_protected')""")
def _(b: Bridge):
    every = R.RetentionParams(**{**P.__dict__, "near_miss_count": 0})
    return R.near_miss(_movies(b), every).select("item_id", display.format_days_left(F.col("days_left")).alias("label"))


@query("format_size", """SELECT item_id, CASE WHEN coalesce(size, 0) = 0 THEN '0 B' WHEN size < 1024 THEN printf('%.2f B', size::double)
WHEN size < 1048576 THEN printf('%.2f KB', size / 1024e0) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576e0)
WHEN size < 1099511627776 THEN printf('%.2f GB', size / 1073741824e0) ELSE printf('%.2f TB', size / 1099511627776e0) END AS label FROM b_items""")
def _(b: Bridge):
    return b.items.select("item_id", display.format_size(F.col("size")).alias("label"))


@query("truncate", """SELECT item_id, CASE WHEN length(path) > 24 THEN path[1:23] || '…' ELSE path END AS short, CASE WHEN length(path) > 20 THEN path[1:20] || '…' ELSE path END AS preview FROM b_items""")
def _(b: Bridge):
    return b.items.select("item_id", display.truncate(F.col("path"), 24).alias("short"), display.preview(F.col("path"), 20).alias("preview"))
