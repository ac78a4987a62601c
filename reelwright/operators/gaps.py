"""What a library lacks: missing episodes, holes in collections, popular titles."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.functions.display import display_name_year
from reelwright.functions.util import first_non_blank, lower_keys, non_blank, provider_id
from reelwright.operators.grouping import counts_with_range, first_per_key, joined_top, spread_join, top_per_key
from reelwright.session import written

UNKNOWN_SERIES = "Unknown Series"


# --------------------------------------------------------------------- missing episodes


def series_titles(series: DataFrame) -> DataFrame:
    """(series_id, series_name, original_series_name) with the fallbacks of the original name."""
    name = F.coalesce("name", F.lit(UNKNOWN_SERIES))
    original = F.col("original_name") if "original_name" in series.columns else F.lit(None).cast("string")
    return series.select(
        F.col("item_id").alias("series_id"), name.alias("series_name"),
        F.coalesce(first_non_blank(F.col("original_title"), original, F.col("sort_name")), name).alias(
            "original_series_name"),
    )


def missing_enrich(missing: DataFrame, series: DataFrame) -> DataFrame:
    """Missing episodes with the names of their series; "Unknown Series" without any."""
    titles = series_titles(series).select(
        "series_id", F.col("series_name").alias("_name"), F.col("original_series_name").alias("_original")
    )
    own = F.nullif("series_name", F.lit(""))
    return (
        missing.join(titles, "series_id", "left")
        .withColumn("original_series_name", F.coalesce("_original", own, F.lit(UNKNOWN_SERIES)))
        .withColumn("series_name", F.coalesce("_name", own, F.lit(UNKNOWN_SERIES)))
        .drop("_name", "_original")
    )


def missing_explicit(episodes: DataFrame, season: int) -> DataFrame:
    """Episodes of a season that the catalogue marks as missing; never those of season 0."""
    numbered = F.coalesce("episode", F.lit(0)) != 0
    return episodes.where(
        numbered & (F.col("season") == season) & (F.lit(season) != 0) & F.coalesce("is_missing", F.lit(False))
    )


def missing_union(*libraries: DataFrame) -> DataFrame:
    """Missing episodes of several libraries, repeats kept."""
    merged = libraries[0]
    for library in libraries[1:]:
        merged = merged.unionByName(library, allowMissingColumns=True)
    return merged


def sequence_gaps(episodes: DataFrame) -> DataFrame:
    """(series_id, season, first_episode, last_episode): runs of numbers that a season leaves out below its last episode.

    ``episode_end``, if there is such a column, is the last number of a file with several episodes. Specials, season 0
    and episode 0, and rows without numbers are left out. Runs are not listed number by number: an episode that is
    numbered by its date leaves one long run. A window holds the different numbers of one season.
    """
    end = F.col("episode_end") if "episode_end" in episodes.columns else F.col("episode")
    spans = episodes.where("season > 0 AND episode > 0").select(
        "series_id", "season", F.col("episode").alias("lo"), F.greatest(F.col("episode"), end).alias("hi")).distinct()
    before = Window.partitionBy("series_id", "season").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.withColumn("reached", F.coalesce(F.max("hi").over(before), F.lit(0)))
    return reached.where("lo > reached + 1").select(
        "series_id", "season", (F.col("reached") + 1).cast("int").alias("first_episode"), (F.col("lo") - 1).cast("int").alias("last_episode"))


def missing_scan(sources: Sequence[tuple[str, DataFrame, DataFrame]], episodes: DataFrame, series: DataFrame) -> DataFrame:
    """Missing episodes of all libraries, each settled by the first source that answers for it, else by its series' numbers.

    ``sources`` are (name, listed episodes with a ``library``, libraries that the source answered for), best first; a
    source may answer with no episodes, which settles the library all the same. Rows are runs of episodes, tagged with the
    series' names and the source; specials are left out. A series without a library belongs to none that is answered for.
    """
    answers = None
    for place, (_, _, libraries) in enumerate(sources):
        own = libraries.select("library", F.lit(place).alias("place"))
        answers = own if answers is None else answers.unionByName(own)
    titles = series_titles(series)
    heads = series.select(F.col("item_id").alias("series_id"), F.col("library"))
    found = sequence_gaps(episodes).join(heads, "series_id").withColumn("source", F.lit("sequence"))
    columns = ["library", "series_id", "season", "first_episode", "last_episode", "source"]
    if answers is not None:
        settled = answers.where("library IS NOT NULL").groupBy("library").agg(F.min("place").alias("place"))
        found = found.join(settled, "library", "left_anti").select(*columns)
        for place, (name, listed, _) in enumerate(sources):
            rows = listed.where("season > 0 AND episode > 0").join(settled.where(F.col("place") == place).select("library"), "library", "left_semi")
            number = F.col("episode").cast("int")
            found = found.unionByName(rows.select("library", "series_id", "season", number.alias("first_episode"), number.alias("last_episode"),
                                                  F.lit(name).alias("source")))
    named = found.select(*columns).join(titles, "series_id", "left")
    return named.withColumns({c: F.coalesce(c, F.lit(UNKNOWN_SERIES)) for c in ("series_name", "original_series_name")})


def missing_dedupe(missing: DataFrame) -> DataFrame:
    """One row per series name, season and episode: the first by air date, then id."""
    filled = missing.withColumns({
        "series_name": F.coalesce("series_name", F.lit(UNKNOWN_SERIES)),
        "season": F.coalesce("season", F.lit(0)),
        "episode": F.coalesce("episode", F.lit(0)),
    })
    return first_per_key(
        filled, ["series_name", "season", "episode"],
        [F.asc_nulls_last("air_date"), F.asc_nulls_last("id"), F.asc_nulls_last("name")],
    )


def missing_by_series(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy("series_name").agg(
        F.min("series_id").alias("series_id"), F.count("*").alias("total_missing"),
        F.countDistinct("season").alias("n_seasons"),
    )


def missing_by_season(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy("series_name", "season").agg(
        F.min("series_id").alias("series_id"), F.count("*").alias("total_missing"),
        F.min("episode").alias("first_episode"), F.max("episode").alias("last_episode"),
    )


def missing_stats(deduped: DataFrame) -> DataFrame:
    """One row of totals; the series with most missing is the least name on a tie."""
    seasons = deduped.groupBy("series_name", "season").agg(F.count("*").alias("n"))
    series = seasons.groupBy("series_name").agg(F.sum("n").alias("n"), F.count("*").alias("n_seasons"))
    most = F.min(F.struct((-F.col("n")).alias("n"), F.col("series_name").alias("name")))
    return series.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_missing_episodes"),
        F.count("*").alias("total_series_affected"),
        F.coalesce(F.sum("n_seasons"), F.lit(0)).alias("total_seasons_affected"),
        F.coalesce(most["name"], F.lit("None")).alias("most_missing_series"),
        F.coalesce(F.sum("n") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("average_missing_per_series"),
    )


def structured_report(deduped: DataFrame) -> DataFrame:
    """Report rows, one per missing episode, with the totals of its season and series; nothing searched yet."""
    totals = missing_by_series(deduped).select("series_name", F.col("total_missing").alias("series_missing"))
    seasons = deduped.groupBy("series_name", "season").agg(
        F.min("series_id").alias("series_id"), F.count("*").alias("episode_count"))
    rows = deduped.select(
        "series_name", "season", F.col("episode").alias("episode_number"),
        F.coalesce("name", F.lit("Unknown Episode")).alias("name"), F.coalesce("air_date", F.lit("")).alias("air_date"),
        F.lit(False).alias("searched"),
    )
    return spread_join(spread_join(rows, seasons, ["series_name", "season"]), totals, "series_name")


def missing_text_rows(deduped: DataFrame) -> DataFrame:
    """Report lines as rows, in report order: series by missing count, then season, episode."""
    totals = missing_by_series(deduped).select("series_name", F.col("total_missing").alias("series_missing"))
    label = F.when(F.col("season") > 0, F.concat(F.lit("Season "), F.col("season").cast("string"))).otherwise(
        F.lit("Specials/Unknown Season")
    )
    date = F.substring_index("air_date", "T", 1)
    line = F.concat(
        F.lit("Episode "), F.col("episode").cast("string"), F.lit(": "), F.coalesce("name", F.lit("Unknown Episode")),
        F.when(non_blank(date), F.concat(F.lit(" (Air Date: "), date, F.lit(")"))).otherwise(F.lit("")),
    )
    rows = spread_join(deduped, totals, "series_name").select(
        "series_missing", "series_name", "season", "episode", label.alias("season_label"), line.alias("line")
    )
    return rows.orderBy(F.desc("series_missing"), "series_name", "season", "episode")


# ---------------------------------------------------------------------- completeness


def completeness_pct(have: Column, total: Column, digits: int) -> Column:
    share = have / F.nullif(total, F.lit(0)) * F.lit(100.0)
    return F.coalesce(F.bround(share, digits), F.lit(0.0))


def series_completeness(series: DataFrame, episodes: DataFrame, missing: DataFrame) -> DataFrame:
    """Per series with missing episodes: counts, share, last added day and first gaps.

    Series that carry the same tmdb id are one; the least item id speaks for them.
    """
    have = episodes.where(non_blank(F.col("series_id"))).groupBy("series_id").agg(
        F.count("*").alias("have"), F.max(F.substring("date_created", 1, 10)).alias("last_added")
    )
    per_season = missing.groupBy("series_id", "season").agg(F.count("*").alias("n"))
    lacking = per_season.groupBy("series_id").agg(F.sum("n").alias("missing"))
    gap = F.concat(F.lit("S"), F.col("season").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" missing"))
    gaps = joined_top(
        per_season.where("season IS NOT NULL").withColumn("gap", gap), ["series_id"], [F.col("season")], 5,
        "gap", "; ", "gaps",
    )
    rows = (
        series.withColumn("tmdb_key", F.coalesce(first_non_blank(provider_id(F.col("provider_ids"), "tmdb")), F.col("item_id")))
        .withColumn("series_id", F.col("item_id"))
        .join(lacking, "series_id")
        .join(have, "series_id", "left")
        .join(gaps, "series_id", "left")
    )
    single = first_per_key(rows, ["tmdb_key"], [F.col("item_id")])
    own = F.coalesce("have", F.lit(0))
    return single.select(
        "item_id", "provider_ids", "production_year", "original_title", "sort_name", "name",
        display_name_year(F.col("name"), F.col("production_year")).alias("label"),
        own.alias("have"), "missing", (own + F.col("missing")).alias("total"),
        completeness_pct(own, own + F.col("missing"), 1).alias("pct"),
        F.coalesce("last_added", F.lit("")).alias("last_added"), F.coalesce("gaps", F.lit("")).alias("gaps"),
    )


def completeness_filter(rows: DataFrame, low: int, high: int, as_of: dt.date | str,
                        days: int | None = None, within: bool = True) -> DataFrame:
    """Rows in a range of missing counts, added within or not within the last days."""
    kept = rows.where(F.col("missing").between(low, high))
    if days is None:
        return kept
    cutoff = F.date_sub(F.lit(str(as_of)).cast("date"), days).cast("string")
    recent = F.col("last_added") >= cutoff
    return kept.where(recent if within else ~recent | (F.col("last_added") == ""))


def completeness_histogram(rows: DataFrame, bins: int = 20) -> DataFrame:
    """Counts per bin of the share complete, over its own range."""
    counts, low, high = counts_with_range(rows, "pct")
    place = F.when(high == low, F.lit(1)).otherwise(
        F.least(F.floor((F.col("pct") - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(bins)) + 1, F.lit(bins))
    )
    return counts.select(place.cast("int").alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("n_series"))


# ------------------------------------------------------------------------ collections


def explode_parts(collections: DataFrame) -> DataFrame:
    """Long rows (collection_id, collection_name, part_id, title, release_date)."""
    return collections.select(
        "collection_id", F.col("name").alias("collection_name"), F.explode("parts").alias("p")
    ).select("collection_id", "collection_name", F.col("p.id").alias("part_id"), F.col("p.title").alias("title"),
             F.col("p.release_date").alias("release_date"))


def library_collections(owned: DataFrame, memberships: DataFrame, parts: DataFrame) -> DataFrame:
    """Parts of the collections that at least one owned movie belongs to."""
    touched = (
        memberships.join(owned.select(F.col("tmdb_id").alias("part_id")), "part_id", "left_semi")
        .select("collection_id").distinct()
    )
    return spread_join(parts, touched, "collection_id", "left_semi")


def _tagged_parts(parts: DataFrame, owned: DataFrame, max_year: int, excluded_year: int | None) -> DataFrame:
    year = F.substring(F.coalesce("release_date", F.lit("")), 1, 4)
    due = year.rlike("^[0-9]{1,4}$") & (year.try_cast("int") <= max_year)
    if excluded_year is not None:
        due = due & (year != str(excluded_year))
    return (
        parts.join(owned.select(F.col("tmdb_id").alias("part_id"), F.col("name").alias("own_name")), "part_id", "left")
        .withColumn("year", year)
        .withColumn("have", F.col("own_name").isNotNull())
        .withColumn("missing", ~F.col("have") & F.coalesce(due, F.lit(False)))
        .withColumn("sort_date", F.coalesce(F.nullif("release_date", F.lit("")), F.lit("9999")))
    )


def _count_parts(tagged: DataFrame) -> DataFrame:
    counts = tagged.groupBy("collection_id").agg(
        F.max("collection_name").alias("collection_name"), F.count("*").alias("total_parts"),
        F.count_if("have").alias("have"), F.count_if("missing").alias("missing"),
    )
    return counts.where("total_parts > 1 AND have > 0 AND missing > 0").withColumn(
        "pct", F.bround(F.col("have") / F.col("total_parts") * 100).cast("int")
    )


def franchise_counts(parts: DataFrame, owned: DataFrame, max_year: int, excluded_year: int | None = None) -> DataFrame:
    """Collections of several parts of which some are owned and some are missing."""
    return _count_parts(_tagged_parts(parts, owned, max_year, excluded_year))


def franchise_gaps(parts: DataFrame, owned: DataFrame, max_year: int, excluded_year: int | None = None) -> DataFrame:
    """The counts with the first five missing and owned titles by release date.

    The tagged parts are read for the counts and for both lists, so they are written once.
    """
    tagged = written(_tagged_parts(parts, owned, max_year, excluded_year), "parts")
    missing_label = F.concat(F.col("title"), F.lit(" ("), F.when(F.col("year") == "", F.lit("?")).otherwise(F.col("year")), F.lit(")"))
    listed = tagged.where("have OR missing").withColumn("label", F.when(F.col("have"), F.col("own_name")).otherwise(missing_label))
    top = top_per_key(listed, ["collection_id", "have"], [F.col("sort_date"), F.col("part_id")], 5, "rank")

    def first_five(kind: Column) -> Column:
        ranked = F.array_sort(F.collect_list(F.when(kind, F.struct("rank", "label"))))
        return F.array_join(F.transform(ranked, lambda r: r["label"]), ", ")

    titles = top.groupBy("collection_id").agg(
        first_five(F.col("missing")).alias("missing_titles"), first_five(F.col("have")).alias("have_titles"))
    return _count_parts(tagged).join(titles, "collection_id")


def export_franchises(parts: DataFrame, owned: DataFrame, max_year: int, min_pct: int, low: int, high: int,
                      excluded_year: int | None = None) -> DataFrame:
    """Missing movies of the collections that pass the filters, one row per movie."""
    tagged = written(_tagged_parts(parts, owned, max_year, excluded_year), "parts")
    wanted = _count_parts(tagged).where((F.col("pct") >= min_pct) & F.col("missing").between(low, high)).select(
        "collection_id", "total_parts", "have", F.col("missing").alias("n_missing"))
    rows = tagged.where("missing").select("collection_id", "collection_name", "part_id", "title", "year")
    return spread_join(rows, wanted, "collection_id")


# ---------------------------------------------------------------------- popular titles


def popular_missing(lists: DataFrame, owned: DataFrame) -> DataFrame:
    """Listed titles the library lacks; the first list, page and place of a title counts."""
    absent = lists.join(owned.select("tmdb_id"), "tmdb_id", "left_anti")
    return first_per_key(absent, ["tmdb_id"], [F.col(c) for c in ("source_order", "page", "position", "title")])


def popular_filter(rows: DataFrame, min_rating: float = 0.0, min_year: int = 0, source: str | None = None,
                   hidden_year: int | None = None) -> DataFrame:
    """Rows by rating, year (0 when it is no number), list, and without one year."""
    year = F.coalesce(F.col("year").try_cast("int"), F.lit(0))
    kept = rows.where((F.col("rating") >= min_rating) & (year >= min_year))
    if source is not None:
        kept = kept.where(F.col("source") == source)
    return kept if hidden_year is None else kept.where(year != hidden_year)


# --------------------------------------------------------------------- export, totals


def export_shows(complete: DataFrame, missing: DataFrame, low: int, high: int, min_pct: float, top: int = 0) -> DataFrame:
    """Wanted episodes of the shows that pass the filters, shows with fewest first.

    Rows stay one per episode; specials are left out. ``top`` keeps that many shows, 0 all.
    """
    shows = complete.where(F.col("missing").between(low, high) & (F.col("pct") >= min_pct))
    wanted = missing.where("season > 0 AND episode IS NOT NULL").select(
        F.col("series_id").alias("item_id"), "season", "episode")
    sized = (
        wanted.groupBy("item_id").agg(F.count("*").alias("n_episodes"))
        .join(shows.select("item_id"), "item_id", "left_semi")
    )
    if top > 0:
        sized = sized.orderBy("n_episodes", "item_id").limit(top)
    show = F.coalesce(first_non_blank(F.col("original_title"), F.col("sort_name")), F.col("name"), F.lit("Unknown"))
    heads = shows.join(sized, "item_id").select(
        "item_id", show.alias("show"), F.try_element_at(lower_keys(F.col("provider_ids")), F.lit("imdb")).alias("imdb_id"),
        F.nullif("production_year", F.lit(0)).alias("year"), "n_episodes",
    )
    return spread_join(wanted, heads, "item_id").orderBy("n_episodes", "item_id", "season", "episode")


def export_header(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("item_id").alias("total_shows"), F.count("*").alias("total_episodes"))


def overview_totals(movies: DataFrame, series: DataFrame, complete: DataFrame, franchises: DataFrame,
                    popular: DataFrame) -> DataFrame:
    """One row of library and gap totals, from one row of each input."""
    n, lacking = F.count("*"), F.sum("missing")
    rows = [
        movies.agg(n.alias("movies")), series.agg(n.alias("series")),
        complete.agg(lacking.alias("missing_episodes"), n.alias("series_with_gaps")),
        franchises.agg(lacking.alias("missing_franchise_movies"), n.alias("franchises_with_gaps")),
        popular.agg(n.alias("popular_missing")),
    ]
    totals = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals.columns])
