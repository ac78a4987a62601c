"""Queries of the quality model's parts and of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.functions import dates, display, quality, text
from reelwright.functions.streams import audio_languages, first_stream
from reelwright.operators import select
from verification.bridge import AS_OF_EPOCH, Bridge
from verification.dedupe import AI_SQL, TIER_MULT, TIER_NAME, _tier_case
from verification.registry import fragment, query

_FLOOR = "CASE WHEN height >= 2000 THEN 6.0e0 WHEN height >= 1000 THEN 2.5e0 WHEN height >= 700 THEN 1.2e0 ELSE 0.0e0 END"
_HDR = "CASE WHEN lower(replace(coalesce(video_range, ''), ' ', '')) IN ('', 'sdr', 'unknown', 'none') THEN 0.0e0 ELSE 1.0e0 END"


def _video(b: Bridge):
    return select.with_streams(b.items)


@query("first_stream", "SELECT item_id, vcodec, width, height, acodec, channels FROM b_items")
def _(b: Bridge):
    v, a = first_stream(F.col("media_streams"), "Video"), first_stream(F.col("media_streams"), "Audio")
    return b.items.select("item_id", v["codec"].alias("vcodec"), v["width"].alias("width"), v["height"].alias("height"),
                          a["codec"].alias("acodec"), a["channels"].alias("channels"))


@query("audio_languages", "SELECT item_id, concat_ws(',', lang1, lang2) AS languages FROM b_items")
def _(b: Bridge):
    return b.items.select("item_id", F.array_join(audio_languages(F.col("media_streams")), ",").alias("languages"))


@query("quality_score", """SELECT library, type, count(*) AS n, round(max(total), 4) AS best, round(min(total), 4) AS worst,
count(*) FILTER (starved) AS n_starved FROM o_scored GROUP BY ALL""")
def _(b: Bridge):
    return select.rate_items(b.items).groupBy("library", "type").agg(
        F.count("*").alias("n"), F.round(F.max("rating"), 4).alias("best"), F.round(F.min("rating"), 4).alias("worst"),
        F.count_if("score.starved").alias("n_starved"))


@query("bitrate_floor", f"SELECT item_id, {_FLOOR} AS floor_mbps FROM b_items")
def _(b: Bridge):
    return _video(b).select("item_id", quality.bitrate_floor(F.col("_video.height")).alias("floor_mbps"))


@query("codec_efficiency", """SELECT proposal_id, CASE codec WHEN 'hevc' THEN 0.65e0 WHEN 'av1' THEN 0.5e0 ELSE 1.0e0 END AS need FROM b_proposals""")
def _(b: Bridge):
    return b.proposals.select("proposal_id", quality.codec_efficiency(F.upper("codec")).alias("need"))


@query("codec_multiplier", """SELECT proposal_id, CASE codec WHEN 'hevc' THEN 1.1e0 WHEN 'av1' THEN 1.15e0 ELSE 1.0e0 END AS plain,
CASE WHEN c % 2 = 0 THEN 1.1e0 WHEN codec = 'hevc' THEN 1.1e0 WHEN codec = 'av1' THEN 1.15e0 ELSE 1.0e0 END AS named FROM b_proposals""")
def _(b: Bridge):
    release = F.when(F.col("c") % 2 == 0, F.lit("Some.Title.2160p.X265-GRP.mkv")).otherwise(F.lit("Some.Title.mkv"))
    return b.proposals.select("proposal_id", quality.codec_multiplier(F.col("codec")).alias("plain"),
                              quality.codec_multiplier(F.col("codec"), release).alias("named"))


@query("hdr_bonus", f"""SELECT item_id, {_HDR} AS bonus, CASE WHEN {_HDR} = 1 OR k % 4 = 0 THEN 1.0e0 ELSE 0.0e0 END AS with_name FROM b_items""")
def _(b: Bridge):
    marked = F.when(F.col("k") % 4 == 0, F.lit("/x/Movie.HDR10+.mkv")).otherwise(F.lit("/hdr/Movie.HDRip.DVDRip.mkv"))
    rng = F.col("_video.video_range")
    return _video(b).select("item_id", quality.hdr_bonus(rng).alias("bonus"),
                            quality.hdr_bonus_with_name(rng, F.col("name"), marked).alias("with_name"))


@query("is_dovi_p5", """SELECT item_id, k % 12 = 4 AS p5, k % 12 = 4 AS p5_by_text FROM b_items""")
def _(b: Bridge):
    untyped = F.col("_video").withField("dv_subtype", F.lit(None).cast("string"))
    return _video(b).select("item_id", quality.is_dovi_p5(F.col("_video")).alias("p5"),
                            quality.is_dovi_p5(untyped).alias("p5_by_text"))


@query("source_tier", f"SELECT item_id, {_tier_case('path', TIER_NAME)} AS tier, {_tier_case('path', TIER_MULT)} AS multiplier FROM b_items")
def _(b: Bridge):
    tier = quality.source_tier(F.col("path"), F.col("name"))
    return b.items.select("item_id", tier.alias("tier"), quality.tier_multiplier(tier).alias("multiplier"))


@query("source_tier_inferred", f"""SELECT item_id, CASE WHEN tier <> 'unknown' THEN tier
WHEN height >= 2000 AND lossless AND r > 40000000 THEN 'bluray_remux' WHEN height >= 2000 AND (lossless OR r > 25000000) THEN 'bluray'
WHEN height >= 2000 AND (streaming OR r > 8000000) THEN 'webdl' WHEN height >= 2000 THEN 'hdtv'
WHEN height >= 1000 AND lossless AND r > 20000000 THEN 'bluray_remux' WHEN height >= 1000 AND (lossless OR r > 12000000) THEN 'bluray'
WHEN height >= 1000 AND (streaming OR r > 3000000) THEN 'webdl' WHEN height >= 1000 THEN 'hdtv'
WHEN height >= 700 AND (lossless OR r > 8000000) THEN 'bluray' WHEN height >= 700 AND (streaming OR r > 2000000) THEN 'webdl'
WHEN height >= 700 THEN 'hdtv' WHEN lossless THEN 'bluray' WHEN streaming THEN 'webdl' ELSE 'unknown' END AS tier FROM
(SELECT *, {_tier_case('path', TIER_NAME)} AS tier, coalesce(vbitrate, 0) AS r, acodec = 'truehd' AS lossless, acodec IN ('eac3', 'aac') AS streaming FROM b_items)""")
def _(b: Bridge):
    tier = quality.source_tier(F.col("path"), F.col("name"))
    return _video(b).select("item_id", quality.source_tier_inferred(
        tier, F.col("bitrate"), F.col("_video.height"), F.col("_audio.codec")).alias("tier"))


@query("source_tier_mismatch", f"""SELECT proposal_id, detected, source_quality_tier IS NOT NULL AND
abs(CASE source_quality_tier WHEN 'bluray' THEN 1.15e0 WHEN 'webdl' THEN 1.0e0 ELSE 1.3e0 END - mult) > 0.01 AS mismatch FROM
(SELECT *, {_tier_case("coalesce(path, name)", TIER_NAME)} AS detected, {_tier_case("coalesce(path, name)", TIER_MULT)} AS mult FROM b_proposals)""")
def _(b: Bridge):
    check = quality.source_tier_mismatch(F.col("source_quality_tier"), F.col("path"), F.col("name"))
    return b.proposals.select("proposal_id", check["detected"].alias("detected"), check["mismatch"].alias("mismatch"))


@query("is_ai_upscale", f"SELECT item_id, {AI_SQL.format('path')} AS upscaled FROM b_items")
def _(b: Bridge):
    return b.items.select("item_id", quality.is_ai_upscale(F.col("path"), F.col("name")).alias("upscaled"))


@query("resolution_pixels", """SELECT proposal_id, CASE lower(resolution) WHEN '2160p' THEN 8294400 WHEN '1080p' THEN 2073600
WHEN '720p' THEN 921600 WHEN '480p' THEN 409920 ELSE 0 END AS pixels FROM b_proposals""")
def _(b: Bridge):
    return b.proposals.select("proposal_id", quality.resolution_pixels(F.col("resolution")).alias("pixels"))


@query("audio_channels_from_label", """SELECT proposal_id, CASE WHEN audio IS NULL THEN 0 WHEN contains(lower(audio), 'atmos') THEN 8
WHEN contains(audio, '5.1') OR audio = 'DTS' THEN 6 ELSE 2 END AS channels FROM b_proposals""")
def _(b: Bridge):
    return b.proposals.select("proposal_id", quality.audio_channels_from_label(F.col("audio")).alias("channels"))


@query("size_bytes", "SELECT proposal_id, coalesce(size_mb, 0) * 1048576 AS bytes FROM b_proposals")
def _(b: Bridge):
    return b.proposals.select("proposal_id", quality.size_bytes_from_mb(F.col("size_mb")).alias("bytes"))


@query("bitrate_bps", "SELECT proposal_id, coalesce(bitrate_kbps, 0) * 1000 AS bps FROM b_proposals")
def _(b: Bridge):
    return b.proposals.select("proposal_id", quality.bitrate_bps_from_kbps(F.col("bitrate_kbps")).alias("bps"))


fragment("o_bpp", """SELECT *, coalesce(vbitrate, 0) / (width * height * 24)::double AS bpp,
CASE vcodec WHEN 'hevc' THEN 0.65e0 ELSE 1.0e0 END AS need FROM b_items""")


def _bpp(b: Bridge):
    v = F.col("_video")
    return _video(b).withColumn("bpp", quality.bits_per_pixel(v["bit_rate"], v["width"], v["height"]))


@query("bits_per_pixel", "SELECT item_id, round(bpp, 8) AS bpp FROM o_bpp")
def _(b: Bridge):
    return _bpp(b).select("item_id", F.round("bpp", 8).alias("bpp"))


@query("bpp_multiplier", """SELECT item_id, CASE WHEN bpp / need >= 0.3 THEN 1.1e0 WHEN bpp / need >= 0.15 THEN 1.05e0
WHEN bpp / need >= 0.08 THEN 1.0e0 WHEN bpp / need >= 0.05 THEN 0.85e0 ELSE 0.5e0 END AS multiplier FROM o_bpp""")
def _(b: Bridge):
    return _bpp(b).select("item_id", quality.bpp_multiplier(F.col("bpp"), F.col("_video.codec")).alias("multiplier"))


@query("quality_red_flags", """SELECT item_id, reason <> '' AS flag, reason FROM (SELECT item_id, CASE
WHEN height >= 2000 THEN CASE WHEN rate < 15e6 * need THEN printf('4K under-bitrate: %.1f Mbps < %.1f Mbps minimum', rate / 1e6, 15e6 * need / 1e6) ELSE critical END
WHEN height >= 1000 THEN CASE WHEN rate < 5e6 * need THEN printf('1080p under-bitrate: %.1f Mbps < %.1f Mbps minimum', rate / 1e6, 5e6 * need / 1e6) ELSE critical END
WHEN height >= 700 THEN CASE WHEN rate < 3e6 * need THEN printf('720p under-bitrate: %.1f Mbps < %.1f Mbps minimum', rate / 1e6, 3e6 * need / 1e6) ELSE critical END
ELSE critical END AS reason FROM (SELECT *, coalesce(vbitrate, 0)::double AS rate,
CASE WHEN bpp > 0 AND bpp < 0.05 THEN printf('Critical BPP: %.4f < 0.05 minimum', bpp) ELSE '' END AS critical FROM o_bpp))""")
def _(b: Bridge):
    v = F.col("_video")
    flag = quality.quality_red_flags(v["height"], v["bit_rate"], F.col("bpp"), v["codec"])
    return _bpp(b).withColumn("f", flag).select("item_id", "f.flag", "f.reason")


@query("estimate_bitrate", """SELECT item_id, cast(trunc(coalesce(size, 0) * 0.9e0 * 8 / 7200.0e0) AS bigint) AS at_two_hours,
cast(trunc(CASE WHEN runtime_ticks IS NULL THEN 0 ELSE coalesce(size, 0) * 0.9e0 * 8 / (runtime_ticks / 600000000.0e0 * 60) END) AS bigint) AS by_runtime FROM b_items""")
def _(b: Bridge):
    return b.items.select("item_id", quality.estimate_bitrate_bps(F.col("size")).alias("at_two_hours"),
                          quality.estimate_bitrate_bps(F.col("size"), dates.ticks_to_minutes(F.col("runtime_ticks"))).alias("by_runtime"))


def _one(x: str, d: int = 1) -> str:
    return f"cast(round_even(cast({x} AS decimal(38,12)), {d}) AS decimal(38,{d}))::varchar"


@query("score_summary", f"""SELECT item_id, 'score ' || {_one('total')} || ' = ' || concat_ws(' + ', 'res ' || {_one('credit')},
CASE WHEN hdr_part <> 0 THEN 'HDR ' || {_one('hdr_part')} END, 'bitrate ' || {_one('mbps')}, 'audio ' || {_one('audio_part')}) ||
coalesce(', ' || nullif(concat_ws(', ', CASE src_m WHEN 1.3 THEN '×1.30 BluRay REMUX' WHEN 1.15 THEN '×1.15 BluRay' WHEN 0.9 THEN '×0.90 HDTV' WHEN 0.95 THEN '×0.95 HDTV' END,
CASE WHEN ai_m < 1 THEN '×0.70 AI-upscale' END, CASE WHEN p5_m < 1 THEN '×0.0001 DV-P5' END), ''), '') ||
CASE WHEN starved THEN ' (bitrate-starved)' ELSE '' END AS summary FROM o_scored""")
def _(b: Bridge):
    return select.rate_items(b.items).select("item_id", quality.score_summary(F.col("score")).alias("summary"))


@query("date_rating", f"""SELECT item_id, coalesce(epoch(try_cast(date_created AS timestamp)), 0)::bigint AS exact,
CASE WHEN try_cast(date_created AS date) IS NULL THEN 0 ELSE least(epoch(try_cast(date_created AS date)), {AS_OF_EPOCH - 200 * 86400}) END::bigint AS by_day FROM b_items""")
def _(b: Bridge):
    return b.items.select("item_id", dates.date_rating_exact(F.col("date_created")).alias("exact"),
                          dates.date_rating_day(F.col("date_created"), AS_OF_EPOCH - 200 * 86400).alias("by_day"))


@query("ticks_to_minutes", "SELECT item_id, runtime_ticks / 6e8 AS minutes, runtime_ticks / 1e7 AS seconds FROM b_items")
def _(b: Bridge):
    return b.items.select("item_id", dates.ticks_to_minutes(F.col("runtime_ticks")).alias("minutes"),
                          dates.ticks_to_seconds(F.col("runtime_ticks")).alias("seconds"))


# -------------------------------------------------------------------------------- text
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("normalize_title", f"SELECT doc_id, md5({_NORM.format('text')}) AS title FROM documents")
def _(b: Bridge):
    return b.table("documents").select("doc_id", F.md5(text.normalize_title(F.col("text"))).alias("title"))


@query("titles_match", f"""SELECT doc_id, a = b AS same, a = b OR contains(a, b) OR contains(b, a) AS fuzzy FROM
(SELECT doc_id, {_NORM.format('text')} AS a, {_NORM.format("source || CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END")} AS b FROM documents)""")
def _(b: Bridge):
    other = F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.lit("")))
    return b.table("documents").select("doc_id", text.titles_match(F.col("text"), other, False).alias("same"),
                                       text.titles_match(F.col("text"), other).alias("fuzzy"))


_WORDS_EN = "the|and|of|with|when|after|before|while|their|there|this|that"
_WORDS_SL = "je|sa|na|do|po|pri|ako|že|sú|ich|jeho|jej|svoj|tak|alebo|však"


@query("is_english_text", f"""SELECT doc_id, NOT regexp_matches(text, '[áčďéěíĺľňóôŕšťúýžÁČĎÉĚÍĹĽŇÓÔŔŠŤÚÝŽůŮ]') AND
len(list_filter(words, lambda w: regexp_full_match(w, '{_WORDS_EN}'))) >= 2 AND len(list_filter(words, lambda w: regexp_full_match(w, '{_WORDS_SL}'))) = 0
AS english FROM (SELECT doc_id, text, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+') AS words FROM documents)""")
def _(b: Bridge):
    return b.table("documents").select("doc_id", text.is_english_text(F.col("text")).alias("english"))


@query("strip_url_credentials", """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '([?&])(ref|utm_source)=[^&#]*', '\\1', 'g'), '&+', '&', 'g'), '[?&]+(#|$)', '\\1')
AS url FROM pages""")
def _(b: Bridge):
    return b.table("pages").select("page_id", text.strip_url_credentials(F.col("url"), ("REF", "utm_source")).alias("url"))


@query("extract_url_key", """SELECT page_id, nullif(regexp_extract(url, '[?&](ref|utm_source)=([^&#]+)', 2), '') AS key FROM pages""")
def _(b: Bridge):
    return b.table("pages").select("page_id", text.extract_url_key(F.col("url"), ("ref", "UTM_source")).alias("key"))


@query("display_name_year", """SELECT item_id, CASE WHEN production_year IS NULL OR contains(name, production_year::varchar) THEN name
ELSE name || ' (' || production_year || ')' END AS label FROM b_items""")
def _(b: Bridge):
    return b.items.select("item_id", display.display_name_year(F.col("name"), F.col("production_year")).alias("label"))


@query("parse_id_list", """SELECT p_partkey, array_to_string([x FOR x IN [trim(y) FOR y IN string_split(p_name || ' , ,' || p_brand || ', ' || p_type || ',', ',')] IF x <> ''], '|') AS ids FROM part""")
def _(b: Bridge):
    raw = F.concat(F.col("p_name"), F.lit(" , ,"), F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit(","))
    return b.table("part").select("p_partkey", F.array_join(text.parse_id_list(raw), "|").alias("ids"))


@query("cache_key_hash", """SELECT proposal_id, md5(json_object('episode', episode, 'name', name, 'season', season, 'year', year)::varchar)[1:16] AS key FROM b_proposals""")
def _(b: Bridge):
    return b.proposals.select("proposal_id", text.cache_key_hash(*[F.col(c) for c in ("episode", "name", "season", "year")]).alias("key"))
