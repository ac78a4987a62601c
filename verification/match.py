"""Queries of the matching family."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from reelwright.operators import match as M
from reelwright.plans.check import check, check_episode_sets, scored_catalogue
from reelwright.sources import sinks
from verification.bridge import AS_OF_EPOCH, Bridge
from verification.dedupe import AI_SQL, TIER_MULT, TIER_NAME, _tier_case
from verification.registry import FRAGMENTS, fragment, query

PRIORITIES = ("slo", "cs", "en")
EXCLUDED = ("tt0000060", "2112", "TT9000018", "11")
_EXC = "('tt0000060', '2112', 'TT9000018', '11')"

# ------------------------------------------------------------------------- shared SQL
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def _score(mp: str, mbps: str, hdr: str, ch: str, epoch: str, height: str, eff: str, size: str, minutes: str) -> str:
    floor = f"CASE WHEN {height} >= 2000 THEN 6.0e0 WHEN {height} >= 1000 THEN 2.5e0 WHEN {height} >= 700 THEN 1.2e0 ELSE 0.0e0 END"
    adequacy = f"CASE WHEN {mbps} > 0 THEN {mbps} WHEN {size} > 0 AND {minutes} > 0 THEN ({size} * 0.9e0 * 8.0e0) / ({minutes} * 60.0e0) / 1e6 ELSE 0.0e0 END"
    return (f"(CASE WHEN ({adequacy}) > 0 AND ({floor}) > 0 AND ({adequacy}) < ({floor}) * ({eff}) THEN {mp} * (({adequacy}) / (({floor}) * ({eff}))) ELSE {mp} END * 10.0e0 "
            f"+ {hdr} * 5.0e0 + {mbps} + {ch} * 0.5e0 + {epoch} / 1e9 * 0.01e0)")


fragment("o_have", f"""SELECT *, {_score('mp', 'mbps', 'hdr_x', 'channels', 'day_epoch', 'height', 'eff', 'sz', 'minutes')} * src_x * ai_m * p5_m AS rating FROM
(SELECT *, CASE WHEN lower(replace(coalesce(video_range, ''), ' ', '')) IN ('', 'sdr', 'unknown', 'none') THEN 0.0e0 ELSE 1.0e0 END AS hdr_x,
coalesce(epoch(try_cast(date_created AS date)), 0) AS day_epoch, {_tier_case('path', TIER_MULT)} AS native_m, ai_m < 1 AS upscaled, width * height AS pixels,
CASE lang1 WHEN 'slo' THEN 0 WHEN 'cze' THEN 1 ELSE 9999 END AS lang_rank, (lang1 IS NOT NULL)::int + (lang2 IS NOT NULL)::int AS n_languages,
CASE WHEN {_tier_case('path', TIER_NAME)} <> 'unknown' THEN src_m WHEN height >= 2000 THEN CASE WHEN acodec = 'truehd' AND coalesce(vbitrate, 0) > 40000000 THEN 1.3e0
WHEN acodec = 'truehd' OR coalesce(vbitrate, 0) > 25000000 THEN 1.15e0 WHEN acodec = 'eac3' OR coalesce(vbitrate, 0) > 8000000 THEN 1.0e0 ELSE 0.9e0 END
WHEN height >= 1000 THEN CASE WHEN coalesce(vbitrate, 0) > 12000000 THEN 1.15e0 WHEN coalesce(vbitrate, 0) > 3000000 THEN 1.0e0 ELSE 0.9e0 END
WHEN height >= 700 THEN CASE WHEN coalesce(vbitrate, 0) > 8000000 THEN 1.15e0 WHEN acodec = 'eac3' OR coalesce(vbitrate, 0) > 2000000 THEN 1.0e0 ELSE 0.9e0 END
WHEN acodec IN ('eac3', 'aac') THEN 1.0e0 ELSE src_m END AS src_x FROM o_factors)""")
fragment("o_want", f"""SELECT *, {_score('mp', 'mbps', 'hdr_x', 'channels', str(AS_OF_EPOCH), 'height', 'eff', 'sz', 'minutes')} * src_m * ai_m AS rating, width * height AS pixels, ai_m < 1 AS upscaled FROM
(SELECT *, width * height / 1e6 AS mp FROM (SELECT *, CASE lower(resolution) WHEN '2160p' THEN 3840 WHEN '1080p' THEN 1920 WHEN '720p' THEN 1280 WHEN '480p' THEN 854 ELSE 0 END AS width,
CASE lower(resolution) WHEN '2160p' THEN 2160 WHEN '1080p' THEN 1080 WHEN '720p' THEN 720 WHEN '480p' THEN 480 ELSE 0 END AS height,
coalesce(bitrate_kbps, 0) * 1000 / 1e6 AS mbps, CASE WHEN hdr IS NULL THEN 0.0e0 ELSE 1.0e0 END AS hdr_x,
CASE WHEN audio IS NULL THEN 0 WHEN contains(lower(audio), 'atmos') THEN 8 WHEN contains(audio, '5.1') OR audio = 'DTS' THEN 6 ELSE 2 END AS channels,
CASE codec WHEN 'hevc' THEN 0.65e0 WHEN 'av1' THEN 0.5e0 ELSE 1.0e0 END AS eff, coalesce(size_mb, 0)::bigint * 1048576 AS sz, duration_minutes AS minutes,
{_tier_case('coalesce(path, name)', TIER_MULT)} AS src_m, {_tier_case("coalesce(path, 'Proposed')", TIER_MULT)} AS native_m, CASE WHEN {AI_SQL.format('coalesce(path, name)')} THEN 0.7e0 ELSE 1.0e0 END AS ai_m,
least(CASE plang1 WHEN 'slo' THEN 0 WHEN 'CZE' THEN 1 WHEN 'en' THEN 2 ELSE 9999 END, CASE plang2 WHEN 'en' THEN 2 ELSE 9999 END) AS lang_rank,
(plang1 IS NOT NULL)::int + (plang2 IS NOT NULL)::int AS n_languages FROM b_proposals))""")
fragment("o_item_ids", """SELECT 'imdb' AS provider, 0 AS place, lower(imdb) AS pid, item_id FROM b_items WHERE imdb <> 'tt0000000'
UNION ALL SELECT 'tmdb', 1, lower(tmdb), item_id FROM b_items WHERE tmdb IS NOT NULL UNION ALL SELECT 'tvdb', 2, lower(tvdb), item_id FROM b_items WHERE tvdb IS NOT NULL""")
fragment("o_series_ids", """SELECT 0 AS place, lower(imdb) AS pid, item_id FROM b_series WHERE imdb IS NOT NULL
UNION ALL SELECT 1, lower(tmdb), item_id FROM b_series WHERE tmdb IS NOT NULL UNION ALL SELECT 2, lower(tvdb), item_id FROM b_series WHERE tvdb IS NOT NULL""")
fragment("o_asked", """SELECT proposal_id, 0 AS place, lower(imdb) AS pid FROM b_proposals WHERE imdb <> '' UNION ALL SELECT proposal_id, 1, lower(tmdb) FROM b_proposals WHERE tmdb <> ''
UNION ALL SELECT proposal_id, 2, lower(tvdb) FROM b_proposals WHERE tvdb <> ''""")
fragment("o_by_provider", """SELECT proposal_id, place, pid, item_id FROM o_asked JOIN o_item_ids USING (place, pid)
QUALIFY place = min(place) OVER (PARTITION BY proposal_id)""")
fragment("o_found_series", """SELECT proposal_id, min(item_id) AS series_id FROM (SELECT proposal_id, item_id, place, min(place) OVER (PARTITION BY proposal_id) AS best FROM o_asked JOIN o_series_ids USING (place, pid))
WHERE place = best GROUP BY 1""")
fragment("o_by_series", """SELECT f.proposal_id, i.item_id FROM o_found_series f JOIN b_proposals p USING (proposal_id) LEFT JOIN b_items i ON i.series_id = f.series_id AND i.season = p.season AND i.episode = p.episode
WHERE p.season IS NOT NULL AND p.episode IS NOT NULL""")
fragment("o_ptitles", f"SELECT DISTINCT {_NORM.format('name')} AS a FROM b_proposals")
fragment("o_ititles", f"SELECT DISTINCT {_NORM.format('name')} AS b FROM b_items")
fragment("o_title_pairs", "SELECT a, b FROM o_ptitles JOIN o_ititles ON a = b OR contains(a, b) OR contains(b, a)")
fragment("o_by_name", f"""SELECT p.proposal_id, i.item_id FROM b_proposals p JOIN o_title_pairs t ON t.a = {_NORM.format('p.name')} JOIN b_items i ON {_NORM.format('i.name')} = t.b
WHERE p.year IS NULL OR i.production_year = p.year""")
fragment("o_named_series", f"""SELECT proposal_id, min(s.item_id) AS series_id FROM b_proposals p JOIN (SELECT *, {_NORM.format('name')} AS n FROM b_series) s
ON contains(s.n, {_NORM.format('p.name')}) OR contains({_NORM.format('p.name')}, s.n) GROUP BY 1""")
fragment("o_cascade", f"""SELECT proposal_id, tier, item_id FROM (SELECT proposal_id, 'provider' AS tier, 1 AS ord, item_id FROM o_by_provider UNION ALL SELECT proposal_id, 'series', 2, item_id FROM o_by_series
UNION ALL SELECT proposal_id, 'name', 3, item_id FROM o_by_name JOIN (SELECT proposal_id FROM b_proposals WHERE season IS NULL OR episode IS NULL) USING (proposal_id)
UNION ALL SELECT f.proposal_id, 'name', 3, i.item_id FROM o_named_series f JOIN b_proposals p USING (proposal_id) LEFT JOIN b_items i ON i.series_id = f.series_id AND i.season = p.season AND i.episode = p.episode WHERE p.season IS NOT NULL)
WHERE proposal_id NOT IN (SELECT proposal_id FROM b_proposals WHERE coalesce(imdb IN {_EXC}, false) OR coalesce(tmdb IN {_EXC}, false) OR coalesce(tvdb IN {_EXC}, false))
QUALIFY ord = min(ord) OVER (PARTITION BY proposal_id)""")
# ranking of the proposal among its set, as the rule states it
fragment("o_field", """SELECT c.proposal_id, c.tier, h.item_id, h.rating, h.lang_rank, h.n_languages, h.upscaled, h.native_m, h.pixels, h.sz FROM o_cascade c JOIN o_have h USING (item_id)""")
fragment("o_rivals", """SELECT proposal_id, tier, item_id, rating, lang_rank, n_languages, upscaled, native_m, pixels, sz FROM o_field UNION ALL SELECT w.proposal_id, NULL, 'proposed', w.rating, w.lang_rank, w.n_languages, w.upscaled, w.native_m, w.pixels, w.sz FROM o_want w
WHERE proposal_id IN (SELECT proposal_id FROM o_field)""")
fragment("o_order", """SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY lang_rank, rating DESC, item_id = 'proposed', item_id) AS by_l,
row_number() OVER (PARTITION BY proposal_id ORDER BY rating DESC, item_id = 'proposed', item_id) AS by_q FROM o_rivals""")
fragment("o_override", """SELECT l.proposal_id, l.item_id <> q.item_id AND ((l.n_languages = 1 AND q.n_languages >= 2 AND ratio > 2.5) OR (l.lang_rank < 9999 AND q.lang_rank = 9999 AND ratio > 5)
OR (l.lang_rank < 9999 AND q.lang_rank < 9999 AND ratio > 4)) AS override FROM (SELECT * FROM o_order WHERE by_l = 1) l JOIN (SELECT * FROM o_order WHERE by_q = 1) q USING (proposal_id),
LATERAL (SELECT CASE WHEN l.rating > 0 THEN q.rating / l.rating ELSE 'inf'::double END AS ratio)""")
fragment("o_compared", f"""SELECT w.proposal_id, CASE WHEN excluded THEN 'excluded' WHEN e.item_id IS NULL THEN 'not_found' ELSE 'found' END AS status, e.item_id AS existing_id, e.rating AS existing_score,
CASE WHEN e.item_id IS NOT NULL THEN w.rating END AS proposed_score, CASE WHEN excluded THEN 'skip' WHEN e.item_id IS NULL THEN 'download'
WHEN NOT w.upscaled AND e.upscaled AND w.native_m >= 1.15 AND w.pixels >= 2073600 AND w.pixels < 8294400 AND e.pixels >= 8294400 AND e.sz > 0 AND w.sz / e.sz >= 1.5 THEN 'download'
WHEN w.upscaled AND NOT e.upscaled AND e.native_m >= 1.15 AND e.pixels >= 2073600 AND e.pixels < 8294400 AND w.pixels >= 8294400 AND w.sz > 0 AND e.sz / w.sz >= 1.5 THEN 'skip'
WHEN CASE WHEN override THEN q_first ELSE l_first END = 'proposed' THEN 'download' ELSE 'skip' END AS recommendation FROM
(SELECT *, coalesce(imdb IN {_EXC}, false) OR coalesce(tmdb IN {_EXC}, false) OR coalesce(tvdb IN {_EXC}, false) AS excluded FROM o_want) w LEFT JOIN o_override USING (proposal_id)
LEFT JOIN (SELECT proposal_id, max(item_id) FILTER (by_l = 1) AS l_first, max(item_id) FILTER (by_q = 1) AS q_first FROM o_order GROUP BY 1) f USING (proposal_id)
LEFT JOIN (SELECT o.* FROM o_order o JOIN o_override USING (proposal_id) WHERE item_id <> 'proposed' QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY CASE WHEN override THEN by_q ELSE by_l END) = 1) e USING (proposal_id)""")
_REASON = "CASE status WHEN 'excluded' THEN 'excluded_id' WHEN 'not_found' THEN 'not_found' ELSE CASE recommendation WHEN 'download' THEN 'better_quality' ELSE 'same_or_worse' END END"


# the same steps over the episodes of requested sets
fragment("b_asked_set", """SELECT b.* REPLACE (b.proposal_id || '|' || s || '|' || e AS proposal_id, s AS season, e AS episode, NULL::int AS bitrate_kbps,
CASE WHEN s = 1 AND e = 1 THEN 40000 ELSE size_mb END AS size_mb), b.proposal_id AS set_id FROM b_proposals b, (VALUES (1, 1), (1, 2), (1, 3), (2, 2)) v(s, e)""")
_SET_STEPS = ("o_want", "o_asked", "o_by_provider", "o_found_series", "o_by_series", "o_ptitles", "o_title_pairs", "o_by_name", "o_named_series",
              "o_cascade", "o_field", "o_rivals", "o_order", "o_override", "o_compared")
for _step in _SET_STEPS:
    _text = re.sub(r"\bb_proposals\b", "b_asked_set", FRAGMENTS[_step])
    fragment(f"{_step}_set", re.sub(rf"\b({'|'.join(_SET_STEPS)})\b", r"\1_set", _text))


def _scored(b: Bridge):
    return M.score_existing(b.items, PRIORITIES, AS_OF_EPOCH)


def _compared(b: Bridge):
    return check(b.proposals, b.items, b.series, PRIORITIES, AS_OF_EPOCH, EXCLUDED)


@query("score_existing", "SELECT item_id, rating AS rating, lang_rank, n_languages, upscaled, native_m AS native_tier, pixels FROM o_have")
def _(b: Bridge):
    return _scored(b).select("item_id", F.col("copy.rating").alias("rating"), "copy.lang_rank", "copy.n_languages", "copy.upscaled",
                             "copy.native_tier", "copy.pixels")


@query("score_proposed", "SELECT proposal_id, rating AS rating, lang_rank, n_languages, upscaled, pixels FROM o_want")
def _(b: Bridge):
    return M.score_proposed(b.proposals, PRIORITIES, AS_OF_EPOCH).select(
        "proposal_id", F.col("proposed.rating").alias("rating"), "proposed.lang_rank", "proposed.n_languages", "proposed.upscaled", "proposed.pixels")


@query("title_pairs", 'SELECT a AS "left", b AS "right" FROM o_title_pairs')
def _(b: Bridge):
    return M.title_pairs(b.proposals.select(F.col("name").alias("title")), b.items.select(F.col("name").alias("title")))


@query("match_by_name", """SELECT proposal_id, count(*) AS n_items, arg_min(item_id, (lang_rank, -rating, item_id)) AS best_by_language, arg_min(item_id, (-rating, item_id)) AS best_by_quality
FROM o_by_name JOIN o_have USING (item_id) GROUP BY 1""")
def _(b: Bridge):
    return M.match_by_name(b.proposals.withColumn("season", F.lit(None).cast("int")), _scored(b)).select(
        "proposal_id", "n_items", F.col("by_language.item_id").alias("best_by_language"), F.col("by_quality.item_id").alias("best_by_quality"))


@query("match_by_provider", """SELECT proposal_id, place, pid, count(*) AS n_items, arg_min(item_id, (lang_rank, -rating, item_id)) AS best_by_language
FROM o_by_provider JOIN o_have USING (item_id) GROUP BY ALL""")
def _(b: Bridge):
    return M.match_by_provider(b.proposals, _scored(b)).select("proposal_id", "place", "pid", "n_items", F.col("by_language.item_id").alias("best_by_language"))


@query("match_episode", """SELECT proposal_id, count(item_id) AS n_items, arg_min(item_id, (-rating, item_id)) AS best_by_quality FROM o_by_series LEFT JOIN o_have USING (item_id) GROUP BY 1""")
def _(b: Bridge):
    rows = M.match_episode(b.proposals, _scored(b), M.find_series(b.proposals, b.series))
    return rows.select("proposal_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("by_quality.item_id").alias("best_by_quality"))


@query("match_cascade", f"""SELECT p.proposal_id, CASE WHEN coalesce(imdb IN {_EXC}, false) OR coalesce(tmdb IN {_EXC}, false) OR coalesce(tvdb IN {_EXC}, false) THEN 'excluded' ELSE coalesce(tier, 'none') END AS tier, coalesce(n, 0) AS n_items
FROM b_proposals p LEFT JOIN (SELECT proposal_id, tier, count(item_id) AS n FROM o_cascade GROUP BY ALL) USING (proposal_id)""")
def _(b: Bridge):
    scored = scored_catalogue(b.items, PRIORITIES, AS_OF_EPOCH)
    return M.match_cascade(b.proposals, scored, b.series, EXCLUDED).select("proposal_id", "tier", "n_items")


@query("rank_candidates", """SELECT series_id, season, episode, item_id, row_number() OVER (PARTITION BY series_id, season, episode ORDER BY lang_rank, rating DESC, item_id)::bigint AS rank,
lang_rank, rating AS rating FROM o_have""")
def _(b: Bridge):
    """Episodes by their numbers; all movies, which have none, are one set."""
    ranked = M.rank_candidates(_scored(b), ["series_id", "season", "episode"])
    return ranked.select("series_id", "season", "episode", "item_id", "rank", "copy.lang_rank", F.col("copy.rating").alias("rating"))


@query("compare_copies", f"""SELECT proposal_id, status, recommendation, {_REASON} AS reason, existing_id, existing_score AS existing_score, proposed_score AS proposed_score,
proposed_score - existing_score AS score_diff FROM o_compared""")
def _(b: Bridge):
    return _compared(b).select("proposal_id", "status", "recommendation", "reason", "existing_id", F.col("existing_score").alias("existing_score"),
                               F.col("proposed_score").alias("proposed_score"), F.col("score_diff").alias("score_diff"))


@query("native_over_upscale", """SELECT h.item_id, w.proposal_id, CASE WHEN NOT w.upscaled AND h.upscaled AND w.native_m >= 1.15 AND w.pixels >= 2073600 AND w.pixels < 8294400 AND h.pixels >= 8294400 AND h.sz > 0 AND w.sz / h.sz >= 1.5 THEN 'download'
WHEN w.upscaled AND NOT h.upscaled AND h.native_m >= 1.15 AND h.pixels >= 2073600 AND h.pixels < 8294400 AND w.pixels >= 8294400 AND w.sz > 0 AND h.sz / w.sz >= 1.5 THEN 'skip' ELSE 'keep' END AS verdict
FROM o_have h JOIN o_want w ON w.proposal_id = cast(h.c as varchar)""")
def _(b: Bridge):
    wanted = M.score_proposed(b.proposals, PRIORITIES, AS_OF_EPOCH).select("proposal_id", "proposed")
    rows = _scored(b).withColumn("proposal_id", F.col("c").cast("string")).join(wanted, "proposal_id")
    return rows.select("item_id", "proposal_id", M.native_over_upscale(F.col("proposed"), F.col("copy"), F.lit("keep")).alias("verdict"))


@query("sink_check_report", f"""SELECT proposal_id, recommendation = 'download' AS should_download, status, {_REASON} AS reason, existing_id,
CASE WHEN status = 'found' THEN CASE WHEN proposed_score > existing_score THEN 'proposed' ELSE 'existing' END END AS winner FROM o_compared""")
def _(b: Bridge):
    report = F.col("report")
    return sinks.check_report(_compared(b)).select(
        "proposal_id", "should_download", F.get_json_object(report, "$.status").alias("status"), F.get_json_object(report, "$.reason").alias("reason"),
        F.get_json_object(report, "$.existing.id").alias("existing_id"), F.get_json_object(report, "$.quality_comparison.winner").alias("winner"))


def _requests(b: Bridge):
    """Packs of two seasons for every title, one episode of which has its own size."""
    return b.proposals.withColumn("episodes", F.expr("map(1, array(1, 2, 3), 2, array(2))")).withColumn(
        "episode_sizes", F.expr("map('1|1', cast(40000 as int))")).withColumn("bitrate_kbps", F.lit(None).cast("int"))


@query("check_episode_set", """SELECT set_id, count(*) AS episodes_checked, count(existing_id) AS episodes_found, NOT bool_or(recommendation = 'download') AS all_same_or_better,
bool_or(recommendation = 'download') OR count(existing_id) < count(*) AS should_download, concat_ws(',',
'1:' || string_agg(CASE WHEN season = 1 AND recommendation = 'download' THEN episode::varchar END, '+' ORDER BY episode),
'2:' || string_agg(CASE WHEN season = 2 AND recommendation = 'download' THEN episode::varchar END, '+' ORDER BY episode)) AS to_download
FROM o_compared_set JOIN (SELECT proposal_id, set_id, season, episode FROM b_asked_set) USING (proposal_id) GROUP BY set_id""")
def _(b: Bridge):
    rows = check_episode_sets(_requests(b), b.items, b.series, PRIORITIES, AS_OF_EPOCH, EXCLUDED)
    lists = F.transform(F.map_entries("episodes_to_download"), lambda e: F.concat(
        e["key"].cast("string"), F.lit(":"), F.array_join(F.transform(e["value"], lambda x: x.cast("string")), "+")))
    return rows.select("set_id", "episodes_checked", "episodes_found", "all_same_or_better", "should_download",
                       F.array_join(lists, ",").alias("to_download"))
