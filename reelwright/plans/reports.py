"""Jobs that write the reports of gaps and genres as nested JSON documents with their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.operators import gaps, genres
from reelwright.operators.grouping import spread_join
from reelwright.session import written
from reelwright.sources.documents import Level, write_document

MISSING = [
    Level("series", ["rank", "series_name"], ["series_name", "original_series_name", "series_id", "total_missing_episodes", "searched"]),
    Level("seasons", ["season_number"], ["season_number", "episode_count"]),
    Level("episodes", ["episode_number"], ["episode_number", "name", "air_date", "searched"]),
]
MISSING_HEAD = ("report_type string, generated_at string, total_missing_episodes bigint, total_series_affected bigint, "
                "total_seasons_affected bigint, libraries_processed array<string>")
MISSING_SCHEMAS = [
    ("series", "series_name string, original_series_name string, series_id string, total_missing_episodes bigint, searched boolean"),
    ("seasons", "season_number int, episode_count bigint"),
    ("episodes", "episode_number int, name string, air_date string, searched boolean"),
]

FLAT = [Level("episodes", ["series_name", "season", "episode", "id"], ["series_name", "season", "episode", "id", "name", "air_date"])]
FLAT_HEAD = ("generated_at string, total_missing_episodes bigint, total_series_affected bigint, total_seasons_affected bigint, "
             "most_missing_series string, average_missing_per_series double, libraries_processed array<string>")
FLAT_SCHEMAS = [("episodes", "series_name string, season int, episode int, id string, name string, air_date string")]

SHOWS = [
    Level("shows", ["n_episodes", "item_id"], ["show", "item_id", "imdb_id", "year"]),
    Level("episodes", ["season", "episode"], ["season", "episode"]),
]
SHOWS_HEAD = "exported_at string, total_shows bigint, total_episodes bigint"
SHOWS_SCHEMAS = [("shows", "show string, item_id string, imdb_id string, year int"), ("episodes", "season int, episode int")]

FRANCHISES = [
    Level("collections", ["rank", "collection_id"], ["collection", "collection_id", "total_parts", "have"]),
    Level("missing_movies", ["year", "part_id"], ["part_id", "title", "year"]),
]
FRANCHISES_HEAD = "exported_at string, total_collections bigint, total_missing_movies bigint"
FRANCHISES_SCHEMAS = [("collections", "collection string, collection_id string, total_parts bigint, have bigint"),
                      ("missing_movies", "part_id string, title string, year string")]

AUDIT = [
    Level("sections", ["section"], ["section"]),
    Level("entries", ["genre", "item_id"], ["genre", "n_items", "canonical", "item_id", "name", "current_genres", "suggested_genres"]),
]
AUDIT_HEAD = "total_items bigint, total_without_genres bigint, normalization_candidates bigint, pct_without double"
AUDIT_SCHEMAS = [("sections", "section string"),
                 ("entries", "genre string, n_items bigint, canonical string, item_id string, name string, "
                             "current_genres array<string>, suggested_genres array<string>")]


def _libraries(names: Sequence[str]):
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def write_missing_report(deduped: DataFrame, libraries: Sequence[str], generated_at: str, path: str) -> None:
    """Missing episodes by series and season, series with most missing first; ``deduped`` is enriched and has one row per episode."""
    rows = written(deduped, "missing")
    names = rows.groupBy("series_name").agg(F.min(F.coalesce("original_series_name", F.lit(""))).alias("original_series_name"))
    report = spread_join(gaps.structured_report(rows), names, "series_name").select(
        "*", (-F.col("series_missing")).alias("rank"), F.col("series_missing").alias("total_missing_episodes"),
        F.col("season").alias("season_number"))
    head = gaps.missing_stats(rows).select(
        F.lit("missing_episodes").alias("report_type"), F.lit(generated_at).alias("generated_at"), "total_missing_episodes",
        "total_series_affected", "total_seasons_affected", _libraries(libraries).alias("libraries_processed"))
    write_document(head, report, MISSING, path)


def write_missing_list(deduped: DataFrame, libraries: Sequence[str], generated_at: str, path: str) -> None:
    """Missing episodes as one flat list under the totals."""
    rows = written(deduped, "missing")
    head = gaps.missing_stats(rows).select(
        F.lit(generated_at).alias("generated_at"), "total_missing_episodes", "total_series_affected", "total_seasons_affected",
        "most_missing_series", "average_missing_per_series", _libraries(libraries).alias("libraries_processed"))
    write_document(head, rows, FLAT, path)


def write_shows_export(shows: DataFrame, exported_at: str, path: str) -> None:
    """The rows of ``export_shows``, shows with fewest episodes first."""
    rows = written(shows, "shows")
    head = gaps.export_header(rows).select(F.lit(exported_at).alias("exported_at"), "total_shows", "total_episodes")
    write_document(head, rows, SHOWS, path)


def write_franchises_export(movies: DataFrame, exported_at: str, path: str) -> None:
    """The rows of ``export_franchises``, collections with most missing movies first."""
    rows = written(movies.select("*", F.col("collection_name").alias("collection"), (-F.col("n_missing")).alias("rank")), "franchises")
    head = rows.agg(F.countDistinct("collection_id").alias("total_collections"), F.count("*").alias("total_missing_movies")).select(
        F.lit(exported_at).alias("exported_at"), "total_collections", "total_missing_movies")
    write_document(head, rows, FRANCHISES, path)


def write_genre_audit(items: DataFrame, path: str) -> None:
    """The audit's totals over three sections: genres by name, items without genres, items to normalise."""
    listed = [
        genres.genre_counts(items).select(F.lit("genre_counts").alias("section"), "genre", "n_items", "canonical"),
        items.where(F.size(F.coalesce("genres", F.array().cast("array<string>"))) == 0).select(
            F.lit("items_without_genres").alias("section"), "item_id", "name"),
        genres.normalization_candidates(items).withColumn("section", F.lit("normalization_candidates")),
    ]
    rows = listed[0]
    for part in listed[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    write_document(genres.genre_audit(items), rows, AUDIT, path)
