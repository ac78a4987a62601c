"""Proposed copies against the catalogue: finding the title, then comparing quality.

A proposal is compared with the best copies of a candidate set (all items of one provider id,
one episode, or one title). A set's best copy by quality and by language does not depend on
the proposal, so every set is reduced to those two copies first, by an aggregate that combines
before the shuffle; a proposal then joins one row per set. No pair of proposal and item is
ever built, however many of either share an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.functions import dates, quality
from reelwright.functions.streams import language_rank
from reelwright.functions.text import normalize_title
from reelwright.functions.util import lower_keys, non_blank
from reelwright.operators.grouping import spread_join
from reelwright.operators.select import override_condition, with_streams
from reelwright.session import cut_lineage, written

GRAM = 4
SET_COLUMNS = ("n_items", "by_language", "by_quality")


# -------------------------------------------------------------------------- scoring


def _raw_languages(streams: Column) -> Column:
    """Distinct non-empty audio languages in lower case."""
    audio = F.filter(streams, lambda s: s["type"] == "Audio")
    spoken = F.transform(audio, lambda s: F.lower(s["language"]))
    return F.coalesce(F.array_distinct(F.filter(spoken, non_blank)), F.array().cast("array<string>"))


def _copy(score: Column, languages: Column, priorities: Sequence[str], item_id: Column, upscaled: Column,
          native_tier: Column, pixels: Column, size: Column) -> Column:
    """What a comparison reads of one copy."""
    rank = language_rank(languages, priorities) if priorities else F.lit(K.NO_LANGUAGE_RANK)
    return F.struct(
        rank.alias("lang_rank"), (-score["total"]).alias("neg"), item_id.alias("item_id"),
        score["total"].alias("rating"), F.size(languages).alias("n_languages"), upscaled.alias("upscaled"),
        native_tier.alias("native_tier"), pixels.cast("bigint").alias("pixels"), size.cast("bigint").alias("size"),
        score.alias("score"),
    )


def score_existing(items: DataFrame, priorities: Sequence[str], as_of_epoch: int) -> DataFrame:
    """Items with their ``copy`` struct, scored the way a proposal is."""
    video, audio = F.col("_video"), F.col("_audio")
    path, name = F.col("path"), F.col("name")
    width, height = F.coalesce(video["width"], F.lit(0)), F.coalesce(video["height"], F.lit(0))
    tier = quality.source_tier_inferred(quality.source_tier(path, name), F.col("bitrate"), height, audio["codec"])
    pixels = width.cast("bigint") * height
    score = quality.quality_score(
        megapixels=pixels / F.lit(1e6), height=height, hdr=quality.hdr_bonus(video["video_range"]),
        bitrate_mbps=F.coalesce("bitrate", F.lit(0)) / F.lit(1e6), channels=F.coalesce(audio["channels"], F.lit(0)),
        date_rating=dates.date_rating_day(F.col("date_created"), as_of_epoch), codec=video["codec"],
        source=quality.tier_multiplier(tier), ai_upscale=quality.is_ai_upscale(path, name),
        dovi_p5=quality.is_dovi_p5(video), size_bytes=F.coalesce("size", F.lit(0)),
        duration_minutes=dates.ticks_to_minutes(F.col("runtime_ticks")),
    )
    rows = with_streams(items).withColumn("_score", score).withColumn(
        "_languages", _raw_languages(F.col("media_streams")))
    copy = _copy(F.col("_score"), F.col("_languages"), priorities, F.col("item_id"), quality.is_ai_upscale(path, name),
                 quality.source_multiplier(path, name), pixels, F.coalesce("size", F.lit(0)))
    return rows.withColumn("copy", copy).drop("_video", "_audio", "_release", "_score", "_languages", "media_streams")


def scored_columns(scored: DataFrame) -> DataFrame:
    """What the candidate sets read of a scored item."""
    return scored.select("item_id", "is_folder", "provider_ids", "type", "name", "production_year",
                         "series_id", "season", "episode", "copy")


def score_proposed(proposals: DataFrame, priorities: Sequence[str], as_of_epoch: int) -> DataFrame:
    """Proposals with their ``copy`` struct; they count as new and never as profile 5."""
    path, name = F.col("path"), F.col("name")
    width, height = quality.label_width(F.col("resolution")), quality.label_height(F.col("resolution"))
    pixels = width.cast("bigint") * height
    size = quality.size_bytes_from_mb(F.col("size_mb"))
    upscaled = quality.is_ai_upscale(path, name)
    score = quality.quality_score(
        megapixels=pixels / F.lit(1e6), height=height, hdr=quality.hdr_bonus(F.col("hdr")),
        bitrate_mbps=quality.bitrate_bps_from_kbps(F.col("bitrate_kbps")) / F.lit(1e6),
        channels=quality.audio_channels_from_label(F.col("audio")), date_rating=F.lit(as_of_epoch).cast("bigint"),
        codec=F.col("codec"), source=quality.source_multiplier(path, name), ai_upscale=upscaled, dovi_p5=F.lit(False),
        size_bytes=size, duration_minutes=F.col("duration_minutes"),
    )
    languages = F.coalesce("audio_languages", F.array().cast("array<string>"))
    rows = proposals.withColumn("_score", score)
    copy = _copy(F.col("_score"), languages, priorities, F.lit("proposed"), upscaled,
                 quality.source_multiplier(path, F.lit("Proposed")), pixels, size)
    return rows.withColumn("proposed", copy).drop("_score")


def rank_candidates(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copies with ``rank`` in their set, from 1, in the order of language, then quality; null keys are equal.

    A range sort on key and order spreads a set of any size over the tasks. Rows are numbered
    within a range, and a range adds the rows that the ranges before it hold of the set.
    """
    copy = F.col("copy")
    order = [copy["lang_rank"], copy["neg"], F.col("item_id")]
    ranged = scored.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = written(ranged.withColumn("_set", F.struct(*keys)), "ranked")
    counts = dealt.groupBy("_set", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_set").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_set", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_set", "_range").orderBy(*order)
    placed = spread_join(dealt.withColumn("_row", F.row_number().over(inside)), bases, ["_set", "_range"])
    return placed.withColumn("rank", F.col("_base") + F.col("_row")).drop("_set", "_range", "_base", "_row")


# ------------------------------------------------------------------------ candidate sets


def _leaders(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per set the best copy by language and by quality, and how many copies there are."""
    copy = F.col("copy")
    by_quality = F.struct(copy["neg"].alias("neg"), F.col("item_id"), copy.alias("copy"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_items"), F.min(copy).alias("by_language"), F.min(by_quality)["copy"].alias("by_quality"))


def _merge_leaders(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaders of a union of disjoint sets."""
    best = F.struct(F.col("by_quality.neg").alias("neg"), F.col("by_quality.item_id").alias("item_id"), F.col("by_quality").alias("copy"))
    return rows.groupBy(*keys).agg(
        F.sum("n_items").alias("n_items"), F.min("by_language").alias("by_language"), F.min(best)["copy"].alias("by_quality"))


def provider_sets(scored: DataFrame) -> DataFrame:
    """Leaders per provider id, ids compared in lower case."""
    exploded = scored.where(~F.coalesce("is_folder", F.lit(False))).select(
        "item_id", "copy", F.explode(lower_keys(F.col("provider_ids"))).alias("provider", "pid"))
    usable = F.col("provider").isin(*K.PROVIDERS) & non_blank(F.col("pid")) & (F.col("pid") != K.PLACEHOLDER_IMDB)
    return _leaders(exploded.where(usable).withColumn("pid", F.lower("pid")), ["provider", "pid"])


def episode_sets(scored: DataFrame) -> DataFrame:
    rows = scored.where("series_id IS NOT NULL AND season IS NOT NULL AND episode IS NOT NULL")
    return _leaders(rows, ["series_id", "season", "episode"])


def _asked_ids(proposals: DataFrame) -> DataFrame:
    """(proposal_id, place, provider, pid) for the ids a proposal gives, best provider first."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(p).alias("provider"), F.lower(p).alias("pid"))
        for i, p in enumerate(K.PROVIDERS)
    ])
    asked = F.filter(entries, lambda e: non_blank(e["pid"]))
    return proposals.select("proposal_id", F.explode(asked).alias("e")).select("proposal_id", "e.*")


def _first_hit(hits: DataFrame, values: Sequence[str]) -> DataFrame:
    """Per proposal the hit of its best provider."""
    return hits.groupBy("proposal_id").agg(
        F.min("place").alias("place"), F.min_by(F.struct(*values), "place").alias("v")
    ).select("proposal_id", "place", "v.*")


def match_by_provider(proposals: DataFrame, scored: DataFrame) -> DataFrame:
    """Proposals with the candidate set of the first provider id that the library knows."""
    hits = spread_join(_asked_ids(proposals), provider_sets(scored), ["provider", "pid"])
    return _first_hit(hits, ["provider", "pid", *SET_COLUMNS])


def find_series(proposals: DataFrame, series: DataFrame) -> DataFrame:
    """(proposal_id, series_id) by the first provider id that some series really carries."""
    ids = series.select("item_id", F.explode(lower_keys(F.col("provider_ids"))).alias("provider", "pid"))
    owners = ids.where(F.col("provider").isin(*K.PROVIDERS) & non_blank(F.col("pid"))).groupBy(
        "provider", F.lower("pid").alias("pid")).agg(F.min("item_id").alias("series_id"))
    return _first_hit(spread_join(_asked_ids(proposals), owners, ["provider", "pid"]), ["series_id"]).drop("place")


def match_episode(proposals: DataFrame, scored: DataFrame, found_series: DataFrame) -> DataFrame:
    """Proposals of a found series with the set of the asked episode; null where it is absent.

    A found series without the episode stays in the result, which rules out a search by name.
    """
    asked = proposals.where("season IS NOT NULL AND episode IS NOT NULL").select("proposal_id", "season", "episode")
    return spread_join(asked.join(found_series, "proposal_id"), episode_sets(scored),
                       ["series_id", "season", "episode"], "left")


# ------------------------------------------------------------------------------- titles


def titles_held(texts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(text, whole): for each text, those of the ``wholes`` that lie in it, itself included; none is empty.

    A text is asked only for its own stretches that can be a whole: at each place, those of the lengths that wholes with the
    same first characters have. So a row is made per place and length of a text, never per pair of a text and a whole, and
    a stretch that many texts share is joined by equality. Both inputs have distinct values.
    """
    first = F.substring("whole", 1, GRAM)
    lengths = wholes.where("whole <> ''").groupBy(first.alias("head")).agg(F.collect_set(F.length("whole")).alias("lengths"))
    # Sizes are guessed without what explode adds, so the rows below look small enough to be sent to all tasks through the
    # driver. An outer join keeps to the heads for that, and only if the table written for them is small.
    lengths = written(lengths, "heads")
    # The first characters of a whole that is shorter than GRAM are all of it, so shorter heads are asked for too.
    places = F.transform(
        F.sequence(F.lit(1), F.length("text")),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("text") - i + 1)),
                              lambda n: F.struct(i.alias("place"), F.substring("text", i, n).alias("head"))))
    asked = texts.where("text <> ''").select("text", F.explode(F.flatten(places)).alias("p")).select("text", "p.*")
    met = spread_join(asked, lengths, "head", "left").select("text", "place", F.explode_outer("lengths").alias("n"))
    stretch = F.substring("text", F.col("place"), F.col("n"))
    found = met.where(F.col("place") + F.col("n") - 1 <= F.length("text")).select("text", "place", stretch.alias("whole"))
    # A stretch that a text has twice is asked for once, at its first place.
    once = found.where(F.instr(F.col("text"), F.col("whole")) == F.col("place")).select("text", "whole")
    return spread_join(once, wholes.select("whole").hint("merge"), "whole").select("text", "whole")


def title_pairs(left: DataFrame, right: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(left, right) of the distinct normalised titles that match.

    Inputs have a column ``title``. Titles that normalise to nothing match each other only. The
    distinct titles are read several times, so they are written to the checkpoint folder once.
    """
    a = cut_lineage(left.select(normalize_title(F.col("title")).alias("left")).where("left IS NOT NULL").distinct())
    b = cut_lineage(right.select(normalize_title(F.col("title")).alias("right")).where("right IS NOT NULL").distinct())
    if not fuzzy:
        return a.join(b, a["left"] == b["right"])
    right_in_left = titles_held(a.toDF("text"), b.toDF("whole")).toDF("left", "right")
    left_in_right = titles_held(b.toDF("text"), a.toDF("whole")).select(F.col("whole").alias("left"), F.col("text").alias("right"))
    nothing = a.where("left = ''").join(b.where("right = ''"), a["left"] == b["right"])
    return right_in_left.unionByName(left_in_right.where("left <> right")).unionByName(nothing)


def _titled(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", normalize_title(F.col("name")))


def by_matching_title(asked: DataFrame, titles: DataFrame, keys: Sequence[str], merge) -> DataFrame:
    """Per asked title and ``keys``, what ``merge(rows, [left, *keys])`` makes of the rows of all titles that match it.

    ``asked`` has distinct titles in ``left``; ``titles`` has them in ``right``, one row per title and keys. Rows of titles that
    hold an asked title are merged as they come from the index, before they are shuffled, so the matching titles of an
    asked one are never listed.
    """
    distinct = cut_lineage(titles.select("right").distinct())
    inside = titles_held(asked.select(F.col("left").alias("text")), distinct.select(F.col("right").alias("whole")))
    around = titles_held(distinct.select(F.col("right").alias("text")), asked.select(F.col("left").alias("whole")))
    nothing = asked.where("left = ''").select("left", F.lit("").alias("right"))
    held = inside.toDF("left", "right").unionByName(nothing).unionByName(
        around.where("text <> whole").select(F.col("whole").alias("left"), F.col("text").alias("right")))
    return merge(held.join(titles, "right"), ["left", *keys])


def match_by_name(proposals: DataFrame, scored: DataFrame) -> DataFrame:
    """Proposals with the set of all items whose title matches, in the asked year if any.

    Requests are reduced to distinct titles and items to the leaders of each title, type and year before they meet;
    the leaders of the titles that match an asked one are rolled up per type and year. A proposal with a season but
    no episode looks for series.
    """
    kind = F.when(F.col("season").isNotNull() & F.col("episode").isNull(), F.lit("Series")).otherwise(F.lit(""))
    year = F.coalesce(F.nullif("year", F.lit(0)), F.lit(-1))
    asked = _titled(proposals.where(non_blank(F.col("name")))).select("proposal_id", F.col("norm").alias("left"), year.alias("asked_year"), kind.alias("kind"))
    asked = cut_lineage(asked)
    titles = _leaders(_titled(scored.where("name IS NOT NULL")), ["norm", "type", "production_year"]).withColumnRenamed("norm", "right")
    titles = cut_lineage(titles)
    rolled = by_matching_title(asked.select("left").distinct(), titles, ["type", "production_year"], _merge_leaders)
    requests = asked.select("left", "asked_year", "kind").distinct()
    fits = ((F.col("asked_year") == -1) | (F.col("asked_year") == F.col("production_year"))) & (
        (F.col("kind") == "") | (F.col("kind") == F.col("type")))
    sets = _merge_leaders(requests.join(rolled, "left").where(fits), ["left", "asked_year", "kind"])
    return spread_join(asked, sets, ["left", "asked_year", "kind"]).select("proposal_id", *SET_COLUMNS)


def find_series_by_name(proposals: DataFrame, series: DataFrame) -> DataFrame:
    """(proposal_id, series_id) of the first series whose title matches."""
    asked = cut_lineage(_titled(proposals.where(non_blank(F.col("name")))).select("proposal_id", F.col("norm").alias("left")))

    def first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min("series_id").alias("series_id"))

    heads = cut_lineage(first(_titled(series.where("name IS NOT NULL")).select(F.col("norm").alias("right"), F.col("item_id").alias("series_id")), ["right"]))
    found = by_matching_title(asked.select("left").distinct(), heads, [], first)
    return spread_join(asked, found, "left").select("proposal_id", "series_id")


# ------------------------------------------------------------------------------ cascade


def is_excluded(excluded: Sequence[str]) -> Column:
    hit = F.lit(False)
    if excluded:
        for p in K.PROVIDERS:
            hit = hit | F.coalesce(F.col(p).isin(*excluded), F.lit(False))
    return hit


def match_cascade(proposals: DataFrame, scored: DataFrame, series: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Every proposal with the tier that settled it and that tier's candidate set.

    Tiers: excluded, provider, series (by id; an absent episode ends the search), name, none. A
    tier gets only the proposals that the tiers before it left open, which are written for it.
    """
    open_ones = proposals.where(~is_excluded(excluded))
    sets = [F.col(c) for c in SET_COLUMNS]
    numbered = F.col("season").isNotNull() & F.col("episode").isNotNull()
    by_id = cut_lineage(match_by_provider(open_ones, scored).select(
        "proposal_id", F.lit("provider").alias("tier"), F.lit(1).alias("order"), *sets))
    unsettled = cut_lineage(open_ones.join(by_id, "proposal_id", "left_anti"))
    by_name = match_by_name(unsettled.where(~numbered), scored).select(
        "proposal_id", F.lit("name").alias("tier"), F.lit(3).alias("order"), *sets)
    episodes = unsettled.where(numbered)
    by_series = cut_lineage(find_series(episodes, series).select("*", F.lit("series").alias("tier"), F.lit(2).alias("order")))
    named = find_series_by_name(episodes.join(by_series, "proposal_id", "left_anti"), series).select(
        "*", F.lit("name").alias("tier"), F.lit(3).alias("order"))
    by_episode = match_episode(episodes, scored, by_series.unionByName(named)).select("proposal_id", "tier", "order", *sets)
    hits = by_id.unionByName(by_episode).unionByName(by_name)
    first = hits.groupBy("proposal_id").agg(F.min_by(F.struct("tier", *SET_COLUMNS), "order").alias("v"))
    settled = proposals.join(first.select("proposal_id", "v.*"), "proposal_id", "left")
    tier = F.when(is_excluded(excluded), "excluded").otherwise(F.coalesce("tier", F.lit("none")))
    return settled.withColumn("tier", tier).withColumn("n_items", F.coalesce("n_items", F.lit(0)))


# --------------------------------------------------------------------------- comparison


def native_over_upscale(proposed: Column, existing: Column, recommendation: Column) -> Column:
    """Recommendation after the rule for a large native 1080p disc copy against an upscaled 4K one."""

    def applies(native: Column, upscaled: Column) -> Column:
        return (
            ~native["upscaled"] & upscaled["upscaled"] & (native["native_tier"] >= K.NATIVE_MIN_TIER)
            & (native["pixels"] >= K.PIXELS_1080P) & (native["pixels"] < K.PIXELS_4K)
            & (upscaled["pixels"] >= K.PIXELS_4K) & (upscaled["size"] > 0)
            & (native["size"] / F.nullif(upscaled["size"], F.lit(0)) >= K.NATIVE_SIZE_RATIO)
        )

    return (
        F.when(applies(proposed, existing), "download")
        .when(applies(existing, proposed), "skip").otherwise(recommendation)
    )


def compare_copies(matched: DataFrame, priorities: Sequence[str]) -> DataFrame:
    """Decision per proposal: status, recommendation, reason, the copy it met and both scores.

    Needs ``proposed`` and the set columns. The proposal joins the set's ranking: by language,
    or by quality where the override holds; on a tie the existing copy stays ahead.
    """
    p, lang, qual = F.col("proposed"), F.col("by_language"), F.col("by_quality")
    beats_quality = p["rating"] > qual["rating"]
    beats_language = (p["lang_rank"] < lang["lang_rank"]) | ((p["lang_rank"] == lang["lang_rank"]) & (p["rating"] > lang["rating"]))
    rows = matched.withColumn("_best_l", F.when(beats_language, p).otherwise(lang)).withColumn(
        "_best_q", F.when(beats_quality, p).otherwise(qual))
    override = (
        F.lit(bool(priorities)) & (F.col("_best_l.item_id") != F.col("_best_q.item_id"))
        & override_condition(F.col("_best_q"), F.col("_best_l"))
    ) if priorities else F.lit(True)
    rows = rows.withColumn("override", F.coalesce(override, F.lit(False)))
    existing = F.when(F.col("override"), qual).otherwise(lang)
    wins = F.when(F.col("override"), beats_quality).otherwise(beats_language)
    rows = rows.withColumn("existing", existing).withColumn("_raw", F.when(wins, "download").otherwise("skip"))
    found = F.col("existing").isNotNull()
    decided = native_over_upscale(p, F.col("existing"), F.col("_raw"))
    excluded = F.col("tier") == "excluded"
    recommendation = F.when(excluded, "skip").when(~found, "download").otherwise(decided)
    return rows.select(
        *[c for c in matched.columns if c not in ("by_language", "by_quality")],
        F.when(excluded, "excluded").when(found, "found").otherwise("not_found").alias("status"),
        recommendation.alias("recommendation"),
        F.when(excluded, "excluded_id").when(~found, "not_found")
        .when(decided == "download", "better_quality").otherwise("same_or_worse").alias("reason"),
        F.col("existing.item_id").alias("existing_id"), F.col("existing.rating").alias("existing_score"),
        F.when(found, p["rating"]).alias("proposed_score"),
        (p["rating"] - F.col("existing.rating")).alias("score_diff"),
        F.col("existing.score").alias("existing_breakdown"), p["score"].alias("proposed_breakdown"),
    )


# ------------------------------------------------------------------------- episode sets


def explode_episode_set(requests: DataFrame) -> DataFrame:
    """One proposal per asked episode, with its own size where one is given.

    ``episodes`` maps a season to episode numbers, ``episode_sizes`` "S|E" to megabytes.
    """
    seasons = requests.drop("season", "episode").select("*", F.explode("episodes").alias("season", "_list"))
    rows = seasons.select("*", F.explode("_list").alias("episode")).drop("_list", "episodes")
    key = F.concat_ws("|", F.col("season").cast("string"), F.col("episode").cast("string"))
    return rows.withColumn("set_id", F.col("proposal_id")).withColumn(
        "proposal_id", F.concat_ws("|", "set_id", key)).withColumn(
        "size_mb", F.coalesce(F.try_element_at("episode_sizes", key), F.col("size_mb"))).drop("episode_sizes")


def episode_set_result(compared: DataFrame) -> DataFrame:
    """Per request: episodes checked and found, and the ones to download per season.

    The lists hold no more than the request's own row did.
    """
    download = F.col("recommendation") == "download"
    per_season = compared.groupBy("set_id", "season").agg(
        F.count("*").alias("checked"), F.count("existing_id").alias("found"), F.bool_or(download).alias("any_download"),
        F.array_sort(F.collect_list(F.when(download, F.col("episode")))).alias("wanted"),
    )
    seasons = F.filter(F.array_sort(F.collect_list(F.struct("season", "wanted"))), lambda s: F.size(s["wanted"]) > 0)
    result = per_season.groupBy("set_id").agg(
        F.sum("checked").alias("episodes_checked"), F.sum("found").alias("episodes_found"),
        (~F.bool_or("any_download")).alias("all_same_or_better"), F.map_from_entries(seasons).alias("episodes_to_download"),
    )
    complete = F.col("all_same_or_better") & (F.col("episodes_found") == F.col("episodes_checked"))
    return result.withColumn("should_download", ~complete)

