"""Queries of the gap family."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.operators import gaps as G
from verification.bridge import AS_OF, Bridge
from verification.registry import fragment, query

fragment("o_missing", """SELECT *, row_number() OVER (PARTITION BY series_key, season, episode ORDER BY air_date, id, name) AS rn FROM
(SELECT *, coalesce(series_name, 'Unknown Series') AS series_key FROM b_missing)""")
fragment("o_dedup", "SELECT series_key AS series_name, * EXCLUDE (series_key, series_name) FROM o_missing WHERE rn = 1")
fragment("o_series_total", "SELECT series_name, count(*) AS n, count(DISTINCT season) AS n_seasons FROM o_dedup GROUP BY 1")

# missing episodes of the catalogue's own series, one per (series, season, episode) that no item has
fragment("o_lack", """SELECT 's' || cast(c as varchar) AS series_id, cast(l_linenumber - 1 as int) AS season, cast(l_quantity as int) AS episode
FROM lineitem JOIN (SELECT o_orderkey, o_custkey AS c FROM orders) ON o_orderkey = l_orderkey""")
fragment("o_complete", """SELECT s.*, coalesce(have, 0) AS have, missing, coalesce(have, 0) + missing AS total,
round_even(cast(coalesce(have, 0) / (coalesce(have, 0) + missing) * 100 AS decimal(38, 12)), 1)::double AS pct, coalesce(last_added, '') AS last_added, gaps,
CASE WHEN production_year IS NULL OR contains(s.name, production_year::varchar) THEN s.name ELSE s.name || ' (' || production_year || ')' END AS label
FROM b_series s JOIN (SELECT series_id, sum(n)::bigint AS missing, array_to_string(list(('S' || season || ': ' || n || ' missing') ORDER BY season)[1:5], '; ') AS gaps
FROM (SELECT series_id, season, count(*) AS n FROM o_lack GROUP BY ALL) GROUP BY 1) m ON m.series_id = s.item_id
LEFT JOIN (SELECT series_id, count(*) AS have, max(left(date_created, 10)) AS last_added FROM b_items WHERE series_id IS NOT NULL GROUP BY 1) h ON h.series_id = s.item_id
QUALIFY row_number() OVER (PARTITION BY coalesce(tmdb, item_id) ORDER BY item_id) = 1""")
fragment("o_parts", """SELECT *, left(coalesce(release_date, ''), 4) AS year, coalesce(release_date, '9999') AS sort_date,
NOT owned AND coalesce(try_cast(left(release_date, 4) AS int) <= 2026, false) AS missing FROM b_collections""")
fragment("o_franchise", """SELECT *, round_even(have / total_parts * 100, 0)::int AS pct FROM (SELECT collection_id, max(collection_name) AS collection_name,
count(*) AS total_parts, count(*) FILTER (owned) AS have, count(*) FILTER (missing) AS missing FROM o_parts GROUP BY 1) WHERE total_parts > 1 AND have > 0 AND missing > 0""")
fragment("o_popular", """SELECT * FROM b_popular WHERE tmdb_id NOT IN (SELECT part_id FROM b_collections WHERE owned)
QUALIFY row_number() OVER (PARTITION BY tmdb_id ORDER BY source_order, page, position, title) = 1""")


def _lack(b: Bridge):
    owners = b.table("orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey AS c")
    return b.table("lineitem").join(owners, "l_orderkey").selectExpr(
        "'s' || cast(c as string) AS series_id", "cast(l_linenumber - 1 as int) AS season", "cast(l_quantity as int) AS episode")


def _complete(b: Bridge):
    return G.series_completeness(b.series, b.items, _lack(b))


@query("missing_dedupe", "SELECT series_name, season, episode, id, air_date FROM o_dedup")
def _(b: Bridge):
    return G.missing_dedupe(b.missing).select("series_name", "season", "episode", "id", "air_date")


@query("missing_enrich", """SELECT l.series_id, coalesce(s.name, 'Unknown Series') AS series_name, CASE WHEN original_title IS NOT NULL THEN original_title WHEN sort_name IS NOT NULL
THEN sort_name ELSE coalesce(s.name, 'Unknown Series') END AS original_series_name, count(*) AS n FROM o_lack l LEFT JOIN b_series s ON s.item_id = l.series_id GROUP BY ALL
UNION ALL SELECT series_id, coalesce(series_name, 'Unknown Series'), coalesce(series_name, 'Unknown Series'), count(*) FROM b_missing GROUP BY ALL""")
def _(b: Bridge):
    both = _lack(b).withColumn("series_name", F.lit(None).cast("string")).unionByName(
        b.missing.select("series_id", "season", "episode", "series_name"))
    return G.missing_enrich(both, b.series).groupBy("series_id", "series_name", "original_series_name").agg(F.count("*").alias("n"))


@query("missing_explicit", "SELECT id, series_id, season, episode FROM b_missing WHERE season = 2 AND episode <> 0 AND library = 'Lib 1'")
def _(b: Bridge):
    flagged = b.missing.withColumn("is_missing", F.col("library") == "Lib 1")
    return G.missing_explicit(flagged, 2).select("id", "series_id", "season", "episode")


@query("missing_by_series", """SELECT t.series_name, min(d.series_id) AS series_id, t.n AS total_missing, t.n_seasons FROM o_series_total t JOIN o_dedup d USING (series_name) GROUP BY ALL""")
def _(b: Bridge):
    return G.missing_by_series(G.missing_dedupe(b.missing))


@query("missing_by_season", """SELECT series_name, season, min(series_id) AS series_id, count(*) AS total_missing, min(episode) AS first_episode,
max(episode) AS last_episode FROM o_dedup GROUP BY series_name, season""")
def _(b: Bridge):
    return G.missing_by_season(G.missing_dedupe(b.missing))


@query("missing_stats", """SELECT sum(n)::bigint AS total_missing_episodes, count(*) AS total_series_affected, sum(n_seasons)::bigint AS total_seasons_affected,
arg_min(series_name, (-n, series_name)) AS most_missing_series, round(sum(n) / count(*), 6) AS average_missing_per_series FROM o_series_total""")
def _(b: Bridge):
    return G.missing_stats(G.missing_dedupe(b.missing)).withColumn(
        "average_missing_per_series", F.round("average_missing_per_series", 6))


@query("missing_union", """SELECT library, count(*) AS n, count(DISTINCT series_id) AS n_series FROM b_missing GROUP BY 1""")
def _(b: Bridge):
    parts = [b.missing.where(F.col("library") == name) for name in ("Lib 0", "Lib 1", "Lib 2")]
    return G.missing_union(*parts).groupBy("library").agg(F.count("*").alias("n"), F.countDistinct("series_id").alias("n_series"))


@query("structured_report", """SELECT series_name, season, episode AS episode_number, name, air_date,
count(*) OVER (PARTITION BY series_name) AS series_missing, count(*) OVER (PARTITION BY series_name, season) AS episode_count FROM o_dedup""")
def _(b: Bridge):
    return G.structured_report(G.missing_dedupe(b.missing)).select(
        "series_name", "season", "episode_number", "name", "air_date", "series_missing", "episode_count")


@query("missing_text_rows", """SELECT count(*) OVER (PARTITION BY series_name) AS series_missing, series_name, season, episode,
CASE WHEN season > 0 THEN 'Season ' || season ELSE 'Specials/Unknown Season' END AS season_label,
'Episode ' || episode || ': ' || name || ' (Air Date: ' || string_split(air_date, 'T')[1] || ')' AS line FROM o_dedup""")
def _(b: Bridge):
    return G.missing_text_rows(G.missing_dedupe(b.missing))


@query("series_completeness", "SELECT item_id, label, have, missing, total, pct, last_added, gaps FROM o_complete")
def _(b: Bridge):
    return _complete(b).select("item_id", "label", "have", "missing", "total", "pct", "last_added", "gaps")


@query("completeness_filter", """SELECT item_id, 'within' AS side FROM o_complete WHERE missing BETWEEN 2 AND 12 AND last_added >= '2001-03-07'
UNION ALL SELECT item_id, 'before' FROM o_complete WHERE missing BETWEEN 2 AND 12 AND (last_added < '2001-03-07' OR last_added = '')""")
def _(b: Bridge):
    rows = _complete(b)
    inside = G.completeness_filter(rows, 2, 12, AS_OF, 300).withColumn("side", F.lit("within"))
    outside = G.completeness_filter(rows, 2, 12, AS_OF, 300, False).withColumn("side", F.lit("before"))
    return inside.select("item_id", "side").unionByName(outside.select("item_id", "side"))


@query("completeness_histogram", """SELECT least(floor((pct - lo) / (hi - lo) * 20) + 1, 20)::int AS bin, count(*) AS n_series FROM o_complete,
(SELECT min(pct) AS lo, max(pct) AS hi FROM o_complete) GROUP BY 1""")
def _(b: Bridge):
    return G.completeness_histogram(_complete(b))


@query("library_collections", """SELECT collection_id, collection_name, count(*) AS n_parts FROM b_collections WHERE collection_id IN
(SELECT collection_id FROM b_collections WHERE owned) GROUP BY ALL""")
def _(b: Bridge):
    parts = b.collection_parts
    return G.library_collections(b.owned_movies, parts, parts).groupBy("collection_id", "collection_name").agg(F.count("*").alias("n_parts"))


@query("library_id_sets", """SELECT type, count(DISTINCT tmdb) AS n_tmdb, count(DISTINCT imdb) AS n_imdb FROM (SELECT type, tmdb, imdb FROM b_items
UNION ALL SELECT type, tmdb, imdb FROM b_series) GROUP BY type""")
def _(b: Bridge):
    from reelwright.sources.catalogue import library_ids

    both = b.items.select("type", "provider_ids", "name").unionByName(b.series.select("type", "provider_ids", "name"))
    ids = library_ids(both, "tmdb").withColumn("p", F.lit("tmdb")).unionByName(library_ids(both, "imdb").withColumn("p", F.lit("imdb")))
    return ids.groupBy("type").agg(F.count_if(F.col("p") == "tmdb").alias("n_tmdb"), F.count_if(F.col("p") == "imdb").alias("n_imdb"))


@query("franchise_gaps", """SELECT f.*, m.t AS missing_titles, h.t AS have_titles FROM o_franchise f JOIN
(SELECT collection_id, array_to_string(list(title || ' (' || CASE WHEN year = '' THEN '?' ELSE year END || ')' ORDER BY sort_date, part_id)[1:5], ', ') AS t FROM o_parts WHERE missing GROUP BY 1) m USING (collection_id) JOIN
(SELECT collection_id, array_to_string(list('My ' || title ORDER BY sort_date, part_id)[1:5], ', ') AS t FROM o_parts WHERE owned GROUP BY 1) h USING (collection_id)""")
def _(b: Bridge):
    return G.franchise_gaps(b.collection_parts, b.owned_movies, 2026)


@query("export_franchises", """SELECT collection_id, collection_name, part_id, title, year, total_parts, have, f.missing AS n_missing FROM
(SELECT * FROM o_parts WHERE missing AND year <> '2020') p JOIN (SELECT * FROM (SELECT collection_id, total_parts, have, pct, o.missing - coalesce(x.n, 0) AS missing FROM o_franchise o LEFT JOIN
(SELECT collection_id, count(*) AS n FROM o_parts WHERE missing AND year = '2020' GROUP BY 1) x USING (collection_id)) WHERE pct >= 66 AND missing BETWEEN 5 AND 40) f USING (collection_id)""")
def _(b: Bridge):
    return G.export_franchises(b.collection_parts, b.owned_movies, 2026, 66, 5, 40, 2020)


@query("popular_missing", "SELECT tmdb_id, source, page, position, title, rating FROM o_popular")
def _(b: Bridge):
    return G.popular_missing(b.popular, b.owned_movies).select("tmdb_id", "source", "page", "position", "title", "rating")


@query("popular_filter", """SELECT tmdb_id, title, rating FROM o_popular WHERE rating >= 4.5 AND coalesce(try_cast(year AS int), 0) >= 1970
AND source = 'Top Rated' AND coalesce(try_cast(year AS int), 0) <> 1990""")
def _(b: Bridge):
    rows = G.popular_missing(b.popular, b.owned_movies)
    return G.popular_filter(rows, 4.5, 1970, "Top Rated", 1990).select("tmdb_id", "title", "rating")


fragment("o_export", """SELECT item_id, CASE WHEN original_title IS NOT NULL THEN original_title WHEN sort_name IS NOT NULL THEN sort_name ELSE name END AS show,
imdb AS imdb_id, production_year AS year, n AS n_episodes FROM o_complete JOIN (SELECT series_id AS item_id, count(*) AS n FROM o_lack WHERE season > 0 GROUP BY 1) USING (item_id)
WHERE missing BETWEEN 3 AND 30 AND pct >= 20 ORDER BY n, item_id LIMIT 100""")


@query("export_shows", "SELECT e.*, l.season, l.episode FROM o_export e JOIN o_lack l ON l.series_id = e.item_id WHERE l.season > 0")
def _(b: Bridge):
    lack = _lack(b)
    return G.export_shows(G.series_completeness(b.series, b.items, lack), lack, 3, 30, 20.0, 100)


@query("overview_totals", """SELECT (SELECT count(*) FROM b_items WHERE type = 'Movie') AS movies, (SELECT count(*) FROM b_series) AS series,
(SELECT sum(missing)::bigint FROM o_complete) AS missing_episodes, (SELECT count(*) FROM o_complete) AS series_with_gaps,
(SELECT sum(missing)::bigint FROM o_franchise) AS missing_franchise_movies, (SELECT count(*) FROM o_franchise) AS franchises_with_gaps,
(SELECT count(*) FROM o_popular) AS popular_missing""")
def _(b: Bridge):
    return G.overview_totals(b.items.where("type = 'Movie'"), b.series, _complete(b),
                             G.franchise_counts(b.collection_parts, b.owned_movies, 2026), G.popular_missing(b.popular, b.owned_movies))


#: Two sources: the first answers for Lib 1, the second for Lib 1 and, with nothing, for Lib 2; other libraries are settled by numbers.
@query("missing_scan", """WITH present AS (SELECT DISTINCT series_id, season, episode AS lo, episode + season % 2 AS hi FROM o_lack WHERE season > 0 AND episode > 0),
reached AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY series_id, season ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM present),
runs AS (SELECT s.library, r.series_id, season, reached + 1 AS first_episode, lo - 1 AS last_episode, 'sequence' AS source FROM reached r JOIN b_series s ON s.item_id = r.series_id
WHERE lo > reached + 1 AND coalesce(s.library, '') NOT IN ('Lib 1', 'Lib 2')
UNION ALL SELECT library, series_id, season, episode, episode, 'listed' FROM b_missing WHERE library = 'Lib 1' AND season > 0 AND episode > 0)
SELECT r.library, r.series_id, season, first_episode, last_episode, source, coalesce(s.name, 'Unknown Series') AS series_name,
CASE WHEN s.item_id IS NULL THEN 'Unknown Series' WHEN original_title IS NOT NULL THEN original_title WHEN sort_name IS NOT NULL THEN sort_name ELSE coalesce(s.name, 'Unknown Series') END AS original_series_name
FROM runs r LEFT JOIN b_series s ON s.item_id = r.series_id""")
def _(b: Bridge):
    present = _lack(b).withColumn("episode_end", F.col("episode") + F.col("season") % 2)
    libraries = lambda *names: b.spark.createDataFrame([(n,) for n in names], "library string")
    sources = [("listed", b.missing, libraries("Lib 1")), ("listed again", b.missing.where("library = 'Lib 1'"), libraries("Lib 1", "Lib 2"))]
    return G.missing_scan(sources, present, b.series)
