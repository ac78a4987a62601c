"""Quality model: factors, multipliers and the score breakdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.functions.paths import basename
from reelwright.functions.util import contains_any, first_non_blank, fixed, literal_map, printed


def codec_efficiency(codec: Column) -> Column:
    """Bitrate a codec needs for the same picture, relative to H.264."""
    name = F.lower(codec)
    expr = F
    for patterns, ratio in K.CODEC_NEED:
        expr = expr.when(contains_any(name, patterns), F.lit(ratio))
    return expr.otherwise(F.lit(1.0))


def codec_multiplier(codec: Column, release_name: Column | None = None) -> Column:
    """Efficiency multiplier; a codec spelled in the release name wins over the stream's."""

    def lookup(text: Column) -> Column:
        expr = F
        for pattern, value in K.CODEC_MULTIPLIERS:
            expr = expr.when(text.contains(pattern), F.lit(value))
        return expr.otherwise(F.lit(None).cast("double"))

    sources = [lookup(F.lower(codec))]
    if release_name is not None:
        sources.insert(0, lookup(F.lower(release_name)))
    return F.coalesce(*sources, F.lit(1.0))


def bitrate_floor(height: Column) -> Column:
    """Mbps under which a picture of this height is starved (H.264 terms)."""
    expr = F
    for minimum, floor in K.BITRATE_FLOORS:
        expr = expr.when(height >= minimum, F.lit(floor))
    return expr.otherwise(F.lit(0.0))


def has_hdr(video_range: Column) -> Column:
    """True for any real HDR range name, false for blank, sdr, unknown and none."""
    name = F.lower(F.replace(F.coalesce(video_range, F.lit("")), F.lit(" "), F.lit("")))
    return ~name.isin("", "sdr", "unknown", "none")


def hdr_marker(text: Column) -> Column:
    return F.coalesce(text.rlike(K.HDR_NAME_PATTERN), F.lit(False))


def hdr_bonus(video_range: Column) -> Column:
    return F.when(has_hdr(video_range), F.lit(1.0)).otherwise(F.lit(0.0))


def hdr_bonus_with_name(video_range: Column, name: Column, path: Column) -> Column:
    """HDR bonus that also trusts an explicit marker in the file name or title."""
    marked = has_hdr(video_range) | hdr_marker(basename(path)) | hdr_marker(name)
    return F.when(marked, F.lit(1.0)).otherwise(F.lit(0.0))


def is_dovi_p5(video: Column) -> Column:
    """True for Dolby Vision profile 5 (no HDR10 fallback layer)."""
    by_type = video["dv_subtype"].startswith("DoviProfile5")
    rng = F.lower(F.replace(video["video_range"], F.lit(" "), F.lit("")))
    by_text = (rng == "dolbyvision") & F.lower(F.trim(video["dv_desc"])).startswith("profile 5")
    return F.coalesce(by_type, F.lit(False)) | F.coalesce(by_text, F.lit(False))


def release_text(path: Column, name: Column) -> Column:
    return F.upper(first_non_blank(path, name))


def source_tier(path: Column, name: Column) -> Column:
    """Source tier named in the path (else the title), best tier first."""
    return tier_in(release_text(path, name))


def tier_in(text: Column) -> Column:
    """Source tier named in a ``release_text``."""
    expr = F
    for tier, _, patterns in K.SOURCE_TIERS:
        expr = expr.when(contains_any(text, [p.upper() for p in patterns]), F.lit(tier))
    return expr.otherwise(F.lit(K.UNKNOWN_TIER[0]))


def tier_multiplier(tier: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(K.TIER_MULTIPLIER), tier), F.lit(K.UNKNOWN_TIER[1])
    )


def source_multiplier(path: Column, name: Column) -> Column:
    return tier_multiplier(source_tier(path, name))


def source_tier_inferred(
    tier: Column, bitrate: Column, height: Column, audio_codec: Column
) -> Column:
    """Tier guessed from bitrate, height and audio codec, only where it is unknown."""
    rate = F.coalesce(bitrate, F.lit(0))
    audio = F.lower(F.coalesce(audio_codec, F.lit("")))
    lossless = audio.isin(*K.LOSSLESS_AUDIO)
    streaming = audio.isin(*K.STREAMING_AUDIO)
    guess = F.when((rate <= 0) & (audio == ""), F.lit(None).cast("string"))
    for minimum, remux, bluray, webdl in K.INFERENCE_THRESHOLDS:
        tall = height >= minimum
        if remux is not None:
            guess = guess.when(tall & lossless & (rate > remux), F.lit("bluray_remux"))
        guess = (
            guess.when(tall & (lossless | (rate > bluray)), F.lit("bluray"))
            .when(tall & (streaming | (rate > webdl)), F.lit("webdl"))
            .when(tall, F.lit("hdtv"))
        )
    guess = guess.when(lossless, F.lit("bluray")).when(streaming, F.lit("webdl"))
    return F.when(tier == K.UNKNOWN_TIER[0], F.coalesce(guess, tier)).otherwise(tier)


def source_tier_mismatch(given_tier: Column, path: Column, name: Column) -> Column:
    """struct(mismatch, given, detected): a caller's tier against the one in the name."""
    detected = source_tier(path, name)
    checked = (F.coalesce(given_tier, F.lit("")) != "") & release_text(path, name).isNotNull()
    gap = F.abs(tier_multiplier(given_tier) - tier_multiplier(detected))
    return F.struct(
        (checked & (gap > 0.01)).alias("mismatch"),
        given_tier.alias("given"),
        detected.alias("detected"),
    )


def is_ai_upscale(path: Column, name: Column) -> Column:
    return ai_upscale_in(release_text(path, name))


def ai_upscale_in(text: Column) -> Column:
    return contains_any(text, sorted({p.upper() for p in K.AI_UPSCALE_PATTERNS}))


def resolution_by_height(width: Column, height: Column) -> Column:
    """Display label by height; the plain size for small pictures."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return (
        F.when((w == 0) | (h == 0), F.lit("Unknown"))
        .when(h >= 2160, F.lit("4K"))
        .when(h >= 1080, F.lit("1080p"))
        .when(h >= 720, F.lit("720p"))
        .when(h >= 480, F.lit("480p"))
        .otherwise(F.concat_ws("x", w.cast("string"), h.cast("string")))
    )


def resolution_by_either(width: Column, height: Column) -> Column:
    """Label by width or height, so that wide crops keep their class; null when small."""
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    expr = F
    for label, ww, hh in (("2160p", 3840, 2160), ("1080p", 1920, 1080),
                          ("720p", 1280, 720), ("480p", 854, 480)):
        expr = expr.when((w >= ww) | (h >= hh), F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def _resolution_side(label: Column, side: int) -> Column:
    table = literal_map({k: v[side] for k, v in K.RESOLUTION_SIZES.items()})
    return F.coalesce(F.try_element_at(table, F.lower(label)), F.lit(0))


def label_width(label: Column) -> Column:
    return _resolution_side(label, 0)


def label_height(label: Column) -> Column:
    return _resolution_side(label, 1)


def resolution_pixels(label: Column) -> Column:
    return label_width(label) * label_height(label)


def audio_channels_from_label(label: Column) -> Column:
    """Channel count named by an audio label; 0 when blank, 2 when nothing matches."""
    text = F.lower(label)
    expr = F.when(F.coalesce(label, F.lit("")) == "", F.lit(0))
    for pattern, channels in K.CHANNEL_LABELS:
        expr = expr.when(text.contains(pattern), F.lit(channels))
    return expr.otherwise(F.lit(K.DEFAULT_CHANNELS))


def size_bytes_from_mb(size_mb: Column) -> Column:
    return F.coalesce(size_mb.cast("bigint"), F.lit(0)) * F.lit(1024 * 1024)


def bitrate_bps_from_kbps(kbps: Column) -> Column:
    return F.coalesce(kbps.cast("bigint"), F.lit(0)) * F.lit(1000)


def bits_per_pixel(bitrate: Column, width: Column, height: Column, fps: int = 24) -> Column:
    """Bits spent per pixel; 0 when the picture size is unknown."""
    pixels = F.coalesce(width, F.lit(0)).cast("bigint") * F.coalesce(height, F.lit(0)) * F.lit(fps)
    return F.when(pixels == 0, F.lit(0.0)).otherwise(
        F.coalesce(bitrate, F.lit(0)).cast("double") / F.nullif(pixels, F.lit(0))
    )


def bpp_multiplier(bpp: Column, codec: Column) -> Column:
    """Multiplier of the bits-per-pixel band, after allowing for the codec."""
    effective = bpp / codec_efficiency(codec)
    expr = F
    for minimum, value in K.BPP_BANDS:
        expr = expr.when(effective >= minimum, F.lit(value))
    return expr.otherwise(F.lit(K.BPP_CRITICAL_MULTIPLIER))


def quality_red_flags(height: Column, bitrate: Column, bpp: Column, codec: Column) -> Column:
    """struct(flag, reason): bitrate under the minimum of its resolution, or critical bpp."""
    need = codec_efficiency(codec)
    rate = F.coalesce(bitrate, F.lit(0)).cast("double")
    reason = F
    tall = F.lit(False)
    for minimum, label, bps in K.RED_FLAG_MINIMUMS:
        inside = ~tall & (height >= minimum)
        limit = F.lit(float(bps)) * need
        text = F.concat(
            F.lit(f"{label} under-bitrate: "), printed(rate / 1e6, 1), F.lit(" Mbps < "),
            printed(limit / 1e6, 1), F.lit(" Mbps minimum"),
        )
        reason = reason.when(inside & (rate < limit), text)
        tall = tall | (height >= minimum)
    reason = reason.when(
        (bpp > 0) & (bpp < K.BPP_CRITICAL),
        F.concat(F.lit("Critical BPP: "), printed(bpp, 4), F.lit(" < 0.05 minimum")),
    ).otherwise(F.lit(""))
    return F.struct((reason != "").alias("flag"), reason.alias("reason"))


def estimate_bitrate_bps(size_bytes: Column, duration_minutes: Column | float = 120) -> Column:
    """Video bits per second of a file, counting 90% of it as video."""
    minutes = duration_minutes if isinstance(duration_minutes, Column) else F.lit(float(duration_minutes))
    size = F.coalesce(size_bytes, F.lit(0))
    usable = (size != 0) & (F.coalesce(minutes, F.lit(0.0)) != 0)
    bps = (size * F.lit(K.VIDEO_SHARE_OF_FILE) * 8) / F.nullif(minutes * 60, F.lit(0.0))
    return F.when(usable, bps.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def estimate_bitrate_mbps(size_bytes: Column, duration_minutes: Column) -> Column:
    size = F.coalesce(size_bytes, F.lit(0))
    usable = (size > 0) & F.coalesce(duration_minutes > 0, F.lit(False))
    mbps = (size * F.lit(K.VIDEO_SHARE_OF_FILE) * 8.0) / (duration_minutes * 60.0) / 1e6
    return F.when(usable, mbps).otherwise(F.lit(0.0))


def quality_score(
    *,
    megapixels: Column,
    height: Column,
    hdr: Column,
    bitrate_mbps: Column,
    channels: Column,
    date_rating: Column,
    codec: Column,
    source: Column,
    ai_upscale: Column,
    dovi_p5: Column,
    size_bytes: Column,
    duration_minutes: Column,
) -> Column:
    """Score breakdown struct; ``total`` is the sum of the parts times the multipliers.

    A known bitrate under the codec-adjusted floor scales the resolution part down; an
    unknown one is estimated from size and duration for that check only, and where it
    cannot be estimated nothing is demoted.
    """
    adequacy = F.when(bitrate_mbps > 0, bitrate_mbps).otherwise(
        estimate_bitrate_mbps(size_bytes, duration_minutes)
    )
    floor = bitrate_floor(height) * codec_efficiency(codec)
    starved = (adequacy > 0) & (floor > 0) & (adequacy < floor)
    credit = F.when(starved, megapixels * (adequacy / F.nullif(floor, F.lit(0.0)))).otherwise(
        megapixels
    ) * F.lit(K.WEIGHT_RESOLUTION)
    hdr_part = hdr * F.lit(K.WEIGHT_HDR)
    bitrate_part = bitrate_mbps * F.lit(K.WEIGHT_BITRATE)
    audio_part = channels * F.lit(K.WEIGHT_AUDIO)
    date_part = (date_rating / F.lit(1e9)) * F.lit(K.WEIGHT_DATE)
    ai = F.when(ai_upscale, F.lit(K.AI_MULTIPLIER)).otherwise(F.lit(1.0))
    p5 = F.when(dovi_p5, F.lit(K.DV_P5_MULTIPLIER)).otherwise(F.lit(1.0))
    total = (credit + hdr_part + bitrate_part + audio_part + date_part) * source * ai * p5
    return F.struct(
        credit.alias("resolution_credit"),
        megapixels.alias("resolution_raw"),
        starved.alias("starved"),
        hdr_part.alias("hdr"),
        bitrate_part.alias("bitrate"),
        audio_part.alias("audio"),
        date_part.alias("date"),
        source.alias("source_multiplier"),
        ai.alias("ai_multiplier"),
        p5.alias("dovi_p5_multiplier"),
        total.alias("total"),
    )


def tier_label(multiplier: Column) -> Column:
    return (
        F.when(multiplier >= 1.3, F.lit("BluRay REMUX"))
        .when(multiplier >= 1.15, F.lit("BluRay"))
        .when(multiplier >= 1.0, F.lit("WEB-DL"))
        .otherwise(F.lit("HDTV"))
    )


def score_summary(score: Column) -> Column:
    """One line that explains a breakdown."""
    parts = F.concat_ws(
        " + ",
        F.concat(F.lit("res "), fixed(score["resolution_credit"], 1)),
        F.when(score["hdr"] != 0, F.concat(F.lit("HDR "), fixed(score["hdr"], 1))),
        F.concat(F.lit("bitrate "), fixed(score["bitrate"], 1)),
        F.concat(F.lit("audio "), fixed(score["audio"], 1)),
    )

    def note(value: Column, digits: int, label: Column) -> Column:
        return F.when(
            F.abs(value - 1.0) > 1e-9,
            F.concat(F.lit("×"), fixed(value, digits), F.lit(" "), label),
        )

    notes = F.concat_ws(
        ", ",
        note(score["source_multiplier"], 2, tier_label(score["source_multiplier"])),
        note(score["ai_multiplier"], 2, F.lit("AI-upscale")),
        note(score["dovi_p5_multiplier"], 4, F.lit("DV-P5")),
    )
    return F.concat(
        F.lit("score "), fixed(score["total"], 1), F.lit(" = "), parts,
        F.when(notes != "", F.concat(F.lit(", "), notes)).otherwise(F.lit("")),
        F.when(score["starved"], F.lit(" (bitrate-starved)")).otherwise(F.lit("")),
    )


def rounded_score(score: Column, digits: int = 2) -> Column:
    """Breakdown with its numbers rounded, for compact output."""
    names = ("resolution_credit", "resolution_raw", "hdr", "bitrate", "audio", "date",
             "source_multiplier", "ai_multiplier", "dovi_p5_multiplier", "total")
    return F.struct(
        score["starved"].alias("starved"),
        *[F.bround(score[n], digits).alias(n) for n in names],
    )
