"""From components to keep/delete decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.functions import dates, display, quality
from reelwright.functions.paths import episode_numbers, episode_of
from reelwright.functions.streams import (
    audio_languages,
    first_stream,
    language_rank,
    matched_language,
    normalize_priorities,
)
from reelwright.functions.util import lower_keys, non_blank, provider_id
from reelwright.operators.grouping import first_per_key, grouped, spread_join

# ---------------------------------------------------------------------------- groups


def series_key(series_name: Column, season: Column, episode: Column) -> Column:
    """What episodes of one group must share; numbers may be 0 (specials)."""
    return (
        F.when(~non_blank(series_name), F.lit(K.NON_SERIES))
        .when(
            season.isNotNull() & episode.isNotNull(),
            F.concat(series_name, F.lit("|S"), season.cast("string"), F.lit("E"), episode.cast("string")),
        )
        .otherwise(series_name)
    )


def component_members(components: DataFrame, metadata: DataFrame) -> DataFrame:
    """Nodes of the components with what decides whether they are the same title."""
    key = series_key(F.col("series_name"), F.col("season"), F.col("episode"))
    return components.join(metadata, "item_id").select(
        "component", "item_id", "is_episode", key.alias("series_key")
    )


def verify_groups(members: DataFrame) -> DataFrame:
    """(group_id, item_id): movie components whole, others split by series and episode.

    The group id is the least item id of the group. Groups of one item disappear. Takes
    ``component_members``, best materialised, as the rows are read twice: once for the parts of the
    components, which also say what a whole component holds, and once to be given their group.
    """
    # A part has a text of its own where the key is null: such rows count in a component without episodes only.
    part = F.coalesce(F.concat(F.lit("="), F.col("series_key")), F.lit(""))
    rows = members.select("component", "item_id", "is_episode", part.alias("part"))
    parts = grouped(rows, ["component", "part"]).agg(
        F.bool_or("is_episode").alias("has_episode"), F.min("item_id").alias("first"), F.max("item_id").alias("last"))
    wholes = parts.groupBy("component").agg(
        F.bool_or("has_episode").alias("split"), F.min("first").alias("least"), F.max("last").alias("most"))
    # What a part says of episodes its component says too; it is read so that both share one exchange.
    split = F.coalesce("has_episode", F.lit(False)) | F.coalesce("split", F.lit(False))
    named = parts.join(wholes, "component").select(
        "component", "part",
        F.when(~split, F.col("least")).when(F.col("part") != "", F.col("first")).alias("group_id"),
        F.when(split, F.col("last")).otherwise(F.col("most")).alias("last_id"),
    ).where("group_id <> last_id").drop("last_id")
    return spread_join(rows.select("component", "part", "item_id"), named, ["component", "part"]).select("group_id", "item_id")


def excluded_id(excluded_ids: Sequence[str]) -> Column:
    """The id of an item that is excluded, or null.

    Ids that start with "tt" are imdb ids (any case); all-digit ids are tried as tmdb and tvdb.
    """
    imdb_ids = [i.lower() for i in excluded_ids if i.lower().startswith("tt")]
    number_ids = [i for i in excluded_ids if i.isdigit()]
    ids = F.col("provider_ids")
    # Few items hold one of the ids at all; the maps of the others are not taken apart.
    held = F.exists(F.map_values(ids), lambda v: F.lower(v).isin(*imdb_ids, *number_ids))
    imdb = F.lower(provider_id(ids, "imdb"))
    tmdb, tvdb = provider_id(ids, "tmdb"), provider_id(ids, "tvdb")
    return F.when(held, F.coalesce(
        F.when(imdb.isin(*imdb_ids), imdb),
        F.when(tmdb.isin(*number_ids), tmdb),
        F.when(tvdb.isin(*number_ids), tvdb),
    ))


def exclusion_hits(members: DataFrame, excluded_ids: Sequence[str]) -> DataFrame:
    """One row per group that holds an excluded id: the item and id that matched first."""
    hits = members.withColumn("excluded_id", excluded_id(excluded_ids)).where("excluded_id IS NOT NULL")
    first = F.min(F.struct("item_id", "excluded_id")).alias("h")
    return hits.groupBy("group_id").agg(first).select("group_id", "h.*")


def group_exclusion(members: DataFrame, excluded_ids: Sequence[str]) -> DataFrame:
    """Members of the groups without any excluded id."""
    return spread_join(members, exclusion_hits(members, excluded_ids), "group_id", "left_anti")


def without_excluded(marked: DataFrame) -> DataFrame:
    """``group_exclusion`` of members that carry their ``excluded_id``, best materialised, as they are read twice."""
    hits = marked.where("excluded_id IS NOT NULL").select("group_id").distinct()
    return spread_join(marked.drop("excluded_id"), hits, "group_id", "left_anti")


def excluded_report(members: DataFrame, excluded_ids: Sequence[str]) -> DataFrame:
    """Details of the item that put each excluded group aside."""
    hits = exclusion_hits(members, excluded_ids)
    video = first_stream(F.col("media_streams"), "Video")
    details = members.select(
        "group_id", "item_id",
        display.format_title(F.col("name"), F.col("series_name")).alias("title"),
        F.col("production_year").alias("year"), "path", F.coalesce("size", F.lit(0)).alias("size"),
        display.format_size(F.col("size"), "Unknown").alias("size_formatted"),
        quality.resolution_by_height(video["width"], video["height"]).alias("resolution"),
        F.array_join(audio_languages(F.col("media_streams")), ",").alias("languages"),
    )
    return hits.join(details, ["group_id", "item_id"])


def with_episode_key(members: DataFrame) -> DataFrame:
    """Adds ``_key``, the series and episode that the file name of an episode says."""
    numbers = F.when(non_blank(F.col("series_name")), episode_numbers(F.col("path")))
    found = episode_of(F.col("_numbers"))
    return members.withColumn("_numbers", numbers).withColumn(
        "_key", F.concat(F.col("series_name"), F.lit("|S"), found["season"], F.lit("E"), found["episode"])
    ).drop("_numbers")


def episode_path_filter(members: DataFrame) -> DataFrame:
    """Where file names disagree on the episode, keep the commonest one and the unnumbered.

    Ties go to the smaller key.
    """
    return commonest_episode(with_episode_key(members))


def commonest_episode(keyed: DataFrame) -> DataFrame:
    """``episode_path_filter`` of members that carry their ``_key``, best materialised, as they are read twice."""
    counts = keyed.where("_key IS NOT NULL").groupBy("group_id", "_key").agg(F.count("*").alias("n"))
    best = counts.groupBy("group_id").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("_key").alias("key")))["key"].alias("_best")
    )
    joined = spread_join(keyed, best, "group_id", "left")
    return joined.where("_key IS NULL OR _key = _best").drop("_key", "_best")


def dedupe_by_path(members: DataFrame) -> DataFrame:
    """The first item per exact path of a group; items without a path and lone items drop out."""
    with_path = members.where(non_blank(F.col("path")))
    several = with_path.groupBy("group_id").agg(
        F.min("path").alias("_first"), F.max("path").alias("_last")
    ).where("_first <> _last").select("group_id")
    return first_per_key(
        spread_join(with_path, several, "group_id", "left_semi"), ["group_id", "path"], [F.col("item_id")]
    )


# ---------------------------------------------------------------------------- rating


def item_score() -> Column:
    """Score breakdown of an item that carries its first ``_video`` and ``_audio`` stream and its ``_release`` text."""
    video, audio = F.col("_video"), F.col("_audio")
    width = F.coalesce(video["width"], F.lit(0)).cast("bigint")
    height = F.coalesce(video["height"], F.lit(0))
    bitrate = F.coalesce(F.nullif(video["bit_rate"], F.lit(0)), F.col("bitrate"), F.lit(0))
    return quality.quality_score(
        megapixels=(width * height) / F.lit(1e6),
        height=height,
        hdr=quality.hdr_bonus_with_name(video["video_range"], F.col("name"), F.col("path")),
        bitrate_mbps=F.greatest(bitrate / F.lit(1e6), F.lit(0.0)),
        channels=F.coalesce(audio["channels"], F.lit(0)),
        date_rating=dates.date_rating_exact(F.col("date_created")),
        codec=video["codec"],
        source=quality.tier_multiplier(quality.tier_in(F.col("_release"))),
        ai_upscale=quality.ai_upscale_in(F.col("_release")),
        dovi_p5=quality.is_dovi_p5(video),
        size_bytes=F.coalesce("size", F.lit(0)),
        duration_minutes=dates.ticks_to_minutes(F.col("runtime_ticks")),
    )


def with_streams(items: DataFrame) -> DataFrame:
    """Adds the first video and audio stream and the release text once, for the many expressions that read them."""
    streams = F.col("media_streams")
    return items.withColumn("_video", first_stream(streams, "Video")).withColumn(
        "_audio", first_stream(streams, "Audio")
    ).withColumn("_release", quality.release_text(F.col("path"), F.col("name")))


def rate_items(items: DataFrame) -> DataFrame:
    """Items that have streams, with their score breakdown and rating."""
    scored = with_streams(items.where("media_streams IS NOT NULL")).withColumn("score", item_score())
    return scored.withColumn("rating", F.col("score.total")).drop("_video", "_audio", "_release")


def quality_description() -> Column:
    """What reports show of an item; "unknown" where a field is missing."""
    video = first_stream(F.col("media_streams"), "Video")
    audio = first_stream(F.col("media_streams"), "Audio")

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("unknown"))

    languages = audio_languages(F.col("media_streams"))
    is_episode = non_blank(F.col("series_name"))
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull()
    return F.struct(
        F.struct(
            shown(video["codec"]).alias("codec"),
            shown(video["bit_rate"]).alias("bitrate"),
            shown(video["bit_depth"]).alias("bit_depth"),
            shown(video["video_range"]).alias("video_range"),
            F.coalesce(video["dv_subtype"], F.lit("")).alias("dv_profile"),
            quality.is_dovi_p5(video).alias("is_dovi_p5"),
        ).alias("video"),
        F.struct(
            shown(audio["codec"]).alias("codec"),
            shown(audio["channels"]).alias("channels"),
            shown(audio["bit_rate"]).alias("bitrate"),
            F.when(F.size(languages) > 0, languages).otherwise(F.array(F.lit("unknown"))).alias("languages"),
        ).alias("audio"),
        F.coalesce("size", F.lit(0)).alias("size"),
        display.format_size(F.col("size"), "unknown").alias("size_formatted"),
        dates.resolve_date_added(
            F.col("date_created"), F.col("date_modified"), F.col("premiere_date"),
            F.col("end_date"), F.col("production_year"),
        ).alias("date_added"),
        dates.premiere_day(F.col("premiere_date")).alias("premiere_date"),
        shown(F.col("production_year")).alias("year"),
        F.coalesce("path", F.lit("unknown")).alias("path"),
        is_episode.alias("is_episode"),
        F.when(is_episode, F.when(numbered, F.concat(
            F.lit("S"), F.col("season").cast("string"), F.lit("E"), F.col("episode").cast("string"),
        )).otherwise(F.lit("Unknown episode"))).alias("episode_info"),
    )


def with_languages(rated: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """Adds the item's languages, its best priority rank and the language behind it."""
    languages = audio_languages(F.col("media_streams"))
    return (
        rated.withColumn("languages", languages)
        .withColumn("lang_rank", language_rank(F.col("languages"), priorities))
        .withColumn("priority_language", matched_language(F.col("lang_rank"), priorities))
    )


# ------------------------------------------------------------------------- decisions


def override_condition(best_q: Column, best_l: Column) -> Column:
    """Whether the best-rated copy beats the best copy in a preferred language.

    Both sides are structs with rating, lang_rank, n_languages and item_id.
    """
    ratio = F.when(best_l["rating"] > 0, best_q["rating"] / F.nullif(best_l["rating"], F.lit(0.0))).otherwise(
        F.lit(float("inf"))
    )
    q_has = best_q["lang_rank"] < K.NO_LANGUAGE_RANK
    l_has = best_l["lang_rank"] < K.NO_LANGUAGE_RANK
    single_vs_multi = (best_l["n_languages"] == 1) & (best_q["n_languages"] >= 2)
    return (
        (single_vs_multi & (ratio > K.OVERRIDE_SINGLE_VS_MULTI))
        | (l_has & ~q_has & (ratio > K.OVERRIDE_NO_PRIORITY))
        | (l_has & q_has & (ratio > K.OVERRIDE_BOTH_PRIORITY))
    )


def smart_override(rated: DataFrame) -> DataFrame:
    """Per group: best copy by quality, best by language, and which of the two is kept.

    One aggregate over the group gives both; ties go to the smaller item id.
    """
    facts = (F.col("lang_rank"), F.size("languages").alias("n_languages"), F.col("priority_language"))
    by_quality = F.struct((-F.col("rating")).alias("neg"), F.col("item_id"), F.col("rating"), *facts)
    by_language = F.struct(
        F.col("lang_rank").alias("place"), (-F.col("rating")).alias("neg"), F.col("item_id"),
        F.col("rating"), *facts,
    )
    has = F.col("lang_rank") < K.NO_LANGUAGE_RANK
    best = rated.groupBy("group_id").agg(
        F.count("*").alias("n_items"),
        F.min(by_quality).alias("q"),
        F.min(F.when(has, by_language)).alias("l"),
    )
    override = F.when(
        F.col("l").isNotNull() & (F.col("q.item_id") != F.col("l.item_id")),
        override_condition(F.col("q"), F.col("l")),
    ).otherwise(F.lit(False))
    best = best.withColumn("override", override)
    by_lang = F.col("l").isNotNull() & ~F.col("override")
    return best.select(
        "group_id", "n_items",
        F.col("q.item_id").alias("best_quality_id"), F.col("l.item_id").alias("best_language_id"),
        "override",
        F.when(by_lang, F.col("l.item_id")).otherwise(F.col("q.item_id")).alias("keep_id"),
        F.when(by_lang, F.col("l.priority_language")).otherwise(F.col("q.priority_language")).alias("priority_language_used"),
    )


# What ``smart_override`` reads of a member besides its group, and ``enrich_decision`` of a kept copy.
CHOICE_COLUMNS = ("item_id", "rating", "languages", "lang_rank", "priority_language")
KEEPER_COLUMNS = ("name", "path", "runtime_ticks")


def decision_columns(rated: DataFrame) -> DataFrame:
    """The columns of rated items that decisions and their reports need, streams left out."""
    ids = F.col("_ids")
    primary = F.coalesce(*[F.try_element_at(ids, F.lit(p)) for p in K.PROVIDERS])
    return rated.withColumn("_ids", lower_keys(F.col("provider_ids"))).select(
        "item_id", "rating", "languages", "lang_rank", "priority_language",
        "name", "path", "library", "runtime_ticks", "size",
        non_blank(F.col("series_name")).alias("is_episode"), "series_name", "season", "episode",
        primary.alias("provider_id"), F.try_element_at(ids, F.lit("tmdb")).alias("tmdb_id"),
        dates.resolve_date_added(
            F.col("date_created"), F.col("date_modified"), F.col("premiere_date"),
            F.col("end_date"), F.col("production_year"),
        ).alias("date_added"),
        first_stream(F.col("media_streams"), "Video")["codec"].alias("codec"),
    )


def select_keep_delete(ranked: DataFrame) -> DataFrame:
    """Rated members with their role; groups in which nothing would be deleted drop out.

    The flags say whether the kept copy was picked by language and whether that changed the
    outcome.
    """
    used = F.col("priority_language_used").isNotNull()
    choice = smart_override(ranked).where("n_items > 1").select(
        "group_id", "keep_id",
        used.alias("selected_by_language"),
        (used & (F.col("keep_id") != F.col("best_quality_id"))).alias("changed_by_language"),
        "priority_language_used",
    )
    joined = spread_join(ranked, choice, "group_id")
    keep = F.col("item_id") == F.col("keep_id")
    return joined.withColumn("role", F.when(keep, F.lit("keep")).otherwise(F.lit("delete")))


def enrich_decision(decisions: DataFrame) -> DataFrame:
    """Decision rows with the name, path and runtime of their group's kept copy."""
    keepers = decisions.where("role = 'keep'").select(
        "group_id", F.coalesce("name", F.lit("Unknown Group")).alias("group_name"),
        F.col("path").alias("keep_path"), F.col("runtime_ticks").alias("keep_runtime_ticks"),
    )
    return spread_join(decisions, keepers, "group_id")


def poster_fallback(image_url: Column, provider: Column, tmdb_id: Column, base: str) -> Column:
    """Image link of a removed copy: the kept copy's, else one built from a numeric id."""
    return F.coalesce(
        image_url,
        F.when(provider.rlike("^[0-9]+$"), F.concat(F.lit(base), provider, F.lit(".jpg"))),
        F.when(non_blank(tmdb_id), F.concat(F.lit(base), tmdb_id, F.lit(".jpg"))),
        F.lit(""),
    )


def language_message(priorities: Sequence[str]) -> Column:
    """Why the kept copy was kept, in words."""
    listed = ", ".join(normalize_priorities(priorities))
    spoken = F.concat(F.lit("'"), F.col("priority_language_used"), F.lit("' audio"))
    return (
        F.when(F.col("changed_by_language"), F.concat(
            F.lit("kept for its "), spoken, F.lit(f" over a better-rated copy (priorities: {listed})")))
        .when(F.col("selected_by_language"), F.concat(
            F.lit("has "), spoken, F.lit(f" and the best rating (priorities: {listed})")))
        .when(F.lit(listed != ""), F.lit(f"priorities ({listed}) did not change the choice"))
        .otherwise(F.lit(""))
    )
