"""Queries of the nested documents: each writes one, reads it back, and is compared by row, with the head on each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.operators import gaps as G
from reelwright.plans import reports
from reelwright.session import shared_folder
from reelwright.sources.documents import read_document, read_head
from verification.bridge import Bridge
from verification.gaps import _lack
from verification.registry import query

AT = "2026-01-01T00:00:00"
LIBRARIES = ("Lib 0", "Lib 1", "Lib 2")
_HEAD = """SELECT (SELECT count(*) FROM o_dedup) AS head_missing, (SELECT count(*) FROM o_series_total) AS head_series,
(SELECT sum(n_seasons)::bigint FROM o_series_total) AS head_seasons"""


def _missing(b: Bridge):
    """The missing episodes; half of the series have a title of their own in another language."""
    titles = b.users.where("user_id % 2 = 0 AND user_id % 17 <> 0").select(
        F.concat(F.lit("v"), "user_id").alias("item_id"), F.concat(F.lit("Show "), "user_id").alias("name"),
        F.concat(F.lit("Original "), "user_name").alias("original_title"), F.lit(None).cast("string").alias("sort_name"))
    return G.missing_dedupe(G.missing_enrich(b.missing, titles))


@query("missing_document", f"""SELECT series_name, CASE WHEN user_id::bigint % 2 = 0 THEN 'Original ' || user_name ELSE series_name END AS original_series_name,
series_id, series_missing, season_number, episode_count, episode_number, name, air_date, false AS searched, 'Lib 0|Lib 1|Lib 2' AS libraries, h.* FROM
(SELECT d.series_name, min(series_id) OVER (PARTITION BY d.series_name) AS series_id, count(*) OVER (PARTITION BY d.series_name) AS series_missing, season AS season_number,
count(*) OVER (PARTITION BY d.series_name, season) AS episode_count, episode AS episode_number, name, air_date FROM o_dedup d) r
LEFT JOIN b_users ON 'Show ' || user_id = series_name CROSS JOIN ({_HEAD}) h""")
def _(b: Bridge):
    path = shared_folder(b.spark, "missing-document")
    reports.write_missing_report(_missing(b), LIBRARIES, AT, path)
    rows = read_document(b.spark, path, reports.MISSING_HEAD, reports.MISSING_SCHEMAS)
    return rows.select(
        "series.series_name", "series.original_series_name", "series.series_id", F.col("series.total_missing_episodes").alias("series_missing"),
        "seasons.season_number", "seasons.episode_count", "episodes.episode_number", "episodes.name", "episodes.air_date",
        (F.col("series.searched") | F.col("episodes.searched")).alias("searched"),
        F.array_join("head.libraries_processed", "|").alias("libraries"), F.col("head.total_missing_episodes").alias("head_missing"),
        F.col("head.total_series_affected").alias("head_series"), F.col("head.total_seasons_affected").alias("head_seasons"))


@query("missing_list_document", f"""SELECT series_name, season, episode, id, name, air_date, h.*, (SELECT series_name FROM o_series_total ORDER BY n DESC, series_name LIMIT 1) AS head_most,
(SELECT round(avg(n), 6) FROM o_series_total) AS head_average FROM o_dedup CROSS JOIN ({_HEAD}) h""")
def _(b: Bridge):
    path = shared_folder(b.spark, "missing-list")
    reports.write_missing_list(G.missing_dedupe(b.missing), LIBRARIES, AT, path)
    rows = read_document(b.spark, path, reports.FLAT_HEAD, reports.FLAT_SCHEMAS)
    return rows.select(
        "episodes.*", F.col("head.total_missing_episodes").alias("head_missing"), F.col("head.total_series_affected").alias("head_series"),
        F.col("head.total_seasons_affected").alias("head_seasons"), F.col("head.most_missing_series").alias("head_most"),
        F.round("head.average_missing_per_series", 6).alias("head_average"))


@query("shows_document", """SELECT e.show, e.item_id, e.imdb_id, e.year, l.season, l.episode, (SELECT count(*) FROM o_export) AS head_shows,
(SELECT sum(n_episodes)::bigint FROM o_export) AS head_episodes FROM o_export e JOIN o_lack l ON l.series_id = e.item_id WHERE l.season > 0""")
def _(b: Bridge):
    lack = _lack(b)
    path = shared_folder(b.spark, "shows")
    reports.write_shows_export(G.export_shows(G.series_completeness(b.series, b.items, lack), lack, 3, 30, 20.0, 100), AT, path)
    rows = read_document(b.spark, path, reports.SHOWS_HEAD, reports.SHOWS_SCHEMAS)
    return rows.select("shows.*", "episodes.*", F.col("head.total_shows").alias("head_shows"), F.col("head.total_episodes").alias("head_episodes"))


@query("franchises_document", """SELECT *, count(*) OVER () AS head_movies, (SELECT count(*) FROM o_franchise WHERE pct >= 40) AS head_collections FROM
(SELECT p.collection_name AS collection, collection_id, total_parts, have, part_id, title, year FROM o_parts p JOIN
(SELECT collection_id, total_parts, have FROM o_franchise WHERE pct >= 40) f USING (collection_id) WHERE p.missing)""")
def _(b: Bridge):
    path = shared_folder(b.spark, "franchises")
    reports.write_franchises_export(G.export_franchises(b.collection_parts, b.owned_movies, 2026, 40, 1, 1_000_000_000), AT, path)
    rows = read_document(b.spark, path, reports.FRANCHISES_HEAD, reports.FRANCHISES_SCHEMAS)
    return rows.select("collections.*", "missing_movies.*", F.col("head.total_missing_movies").alias("head_movies"),
                       F.col("head.total_collections").alias("head_collections"))


@query("genre_audit_document", """SELECT section, genre, n_items, canonical, item_id, name, current, suggested, (SELECT count(*) FROM o_gx) AS head_items,
(SELECT count(*) FROM o_gx WHERE mapped <> genres) AS head_candidates FROM
(SELECT 'genre_counts' AS section, genre, n_items, canonical, NULL AS item_id, NULL AS name, '' AS current, '' AS suggested FROM o_gcount
UNION ALL SELECT 'items_without_genres', NULL, NULL, NULL, item_id, name, '', '' FROM o_gx WHERE len(genres) = 0
UNION ALL SELECT 'normalization_candidates', NULL, NULL, NULL, item_id, name, array_to_string(genres, '|'), array_to_string(mapped, '|') FROM o_gx WHERE mapped <> genres)""")
def _(b: Bridge):
    path = shared_folder(b.spark, "genre-audit")
    reports.write_genre_audit(b.genre_items, path)
    rows = read_document(b.spark, path, reports.AUDIT_HEAD, reports.AUDIT_SCHEMAS)
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return rows.select("sections.section", "entries.genre", "entries.n_items", "entries.canonical", "entries.item_id", "entries.name",
                       text("entries.current_genres").alias("current"), text("entries.suggested_genres").alias("suggested"),
                       F.col("head.total_items").alias("head_items"), F.col("head.normalization_candidates").alias("head_candidates"))


@query("document_heads", """SELECT 'audit' AS document, count(*) AS first_total, count(*) FILTER (len(genres) = 0) AS second_total FROM o_gx
UNION ALL SELECT 'list', (SELECT count(*) FROM o_dedup), (SELECT count(*) FROM o_series_total)""")
def _(b: Bridge):
    audit, flat = shared_folder(b.spark, "genre-audit"), shared_folder(b.spark, "missing-list")
    reports.write_genre_audit(b.genre_items, audit)
    reports.write_missing_list(G.missing_dedupe(b.missing), LIBRARIES, AT, flat)
    heads = [("audit", read_head(b.spark, audit, reports.AUDIT_HEAD, "sections"), "total_items", "total_without_genres"),
             ("list", read_head(b.spark, flat, reports.FLAT_HEAD, "episodes"), "total_missing_episodes", "total_series_affected")]
    rows = [head.select(F.lit(name).alias("document"), F.col(one).alias("first_total"), F.col(two).alias("second_total"))
            for name, head, one, two in heads]
    return rows[0].unionByName(rows[1])
