"""Views that shape the supplied tables into catalogue tables, in Spark and in DuckDB SQL.

The supplied tables are a star schema with events and documents. Each view below gives every
row of one of them the columns of a catalogue table, by plain arithmetic on its keys. Column
texts are shared by both dialects through three macros: IDIV(a, b) is integer division,
DAY(x) the ISO day of a timestamp, and INT64(x) a floor to a 64-bit integer.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwright.session import cut_lineage, tune

AS_OF = "2002-01-01"          # reference day of views built on orders and lineitem
PLAYBACK_AS_OF = "2024-12-31"  # reference day of playback
AS_OF_EPOCH = 1009843200       # AS_OF as epoch seconds

Level = dict[str, str]


def _spark_text(text: str) -> str:
    text = re.sub(r"IDIV\(([^,()]+), ?([^()]+?)\)", r"(\1 div \2)", text)
    text = re.sub(r"DAY\(([^()]+)\)", r"date_format(\1, 'yyyy-MM-dd')", text)
    return re.sub(r"INT64\(([^()]+)\)", r"cast(floor(\1) as bigint)", text)


def _duck_text(text: str) -> str:
    text = re.sub(r"IDIV\(([^,()]+), ?([^()]+?)\)", r"(\1 // \2)", text)
    text = re.sub(r"DAY\(([^()]+)\)", r"strftime(\1, '%Y-%m-%d')", text)
    return re.sub(r"INT64\(([^()]+)\)", r"cast(floor(\1) as bigint)", text)


def _spark_levels(df: DataFrame, levels: list[Level], where: str | None = None) -> DataFrame:
    if where:
        df = df.where(_spark_text(where))
    for level in levels:
        df = df.selectExpr("*", *[f"{_spark_text(e)} AS {n}" for n, e in level.items()])
    return df


def _duck_levels(source: str, levels: list[Level], where: str | None = None) -> str:
    sql = f"SELECT * FROM {source}" + (f" WHERE {_duck_text(where)}" if where else "")
    for level in levels:
        columns = ", ".join(f"{_duck_text(e)} AS {n}" for n, e in level.items())
        sql = f"SELECT *, {columns} FROM ({sql})"
    return sql


def _pick(key: str, values: list[str]) -> str:
    """CASE that picks a literal by the value of an integer expression."""
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {key} {arms} ELSE {values[-1]} END"


_ROOT = _pick("c % 4", ["'/Movies/4K'", "'/Movies/Dokumenty'", "'/Movies/DiViX'", "'/data/lib3'"])

# ------------------------------------------------------------------ items, from orders
ITEM_LEVELS: list[Level] = [
    {"k": "o_orderkey", "c": "o_custkey"},
    {
        "item_id": "cast(k as string)",
        "is_ep": "c % 3 = 0",
        "season": "CASE WHEN c % 3 = 0 THEN cast(k % 3 as int) END",
        "episode": "CASE WHEN c % 3 = 0 THEN cast(1 + IDIV(k, 3) % 2 as int) END",
        "root": _ROOT,
        "tag": _pick("k % 6", ["'2160p.REMUX'", "'1080p.BluRay'", "'1080p.WEB-DL'", "'720p.HDTV'",
                               "'2160p.AI.Upscale.WEB-DL'", "'480p'"]),
        "qtr": "extract(quarter from o_orderdate)",
        "prio": "cast(substr(o_orderpriority, 1, 1) as int)",
        "stat": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END",
    },
    {
        "type": "CASE WHEN is_ep THEN 'Episode' ELSE 'Movie' END",
        "library": "'Lib ' || cast(c % 4 as string)",
        "series_id": "CASE WHEN is_ep THEN 's' || cast(c as string) END",
        "series_name": "CASE WHEN is_ep THEN 'Series ' || cast(c as string) END",
        "ep_text": "CASE WHEN is_ep THEN 'S' || lpad(cast(season as string), 2, '0') || 'E' || "
                   "lpad(cast(episode as string), 2, '0') || ' ' ELSE '' END",
        "imdb": "CASE WHEN k % 10 = 0 THEN NULL WHEN k % 17 = 0 THEN 'tt0000000' "
                "ELSE 'tt' || lpad(cast(c * 4 + qtr - 1 as string), 7, '0') END",
        "tmdb": "CASE WHEN k % 10 <> 0 THEN cast(c * 100 + prio * 10 + stat as string) END",
        "tvdb": "CASE WHEN k % 20 = 0 THEN cast(c as string) END",
        "tmdbcollection": "CASE WHEN k % 6 = 5 THEN cast(c % 50 as string) END",
        "width": _pick("k % 6", ["3840", "1920", "1920", "1280", "3840", "854"]),
        "height": _pick("k % 6", ["2160", "1080", "804", "720", "2160", "480"]),
        "vcodec": _pick("k % 6", ["'hevc'", "'h264'", "'h264'", "'h264'", "'hevc'", "'mpeg4'"]),
        "video_range": _pick("k % 6", ["'HDR 10'", "'SDR'", "'SDR'", "NULL", "'DolbyVision'", "''"]),
        "dv_subtype": "CASE WHEN k % 12 = 4 THEN 'DoviProfile50' WHEN k % 12 = 10 THEN 'DoviProfile81' END",
        "dv_desc": "CASE WHEN k % 12 = 4 THEN 'Profile 5.0' WHEN k % 12 = 10 THEN 'Profile 8.1' END",
        "acodec": _pick("k % 6", ["'truehd'", "'dts'", "'eac3'", "'ac3'", "'eac3'", "'aac'"]),
        "channels": _pick("k % 6", ["8", "6", "6", "2", "8", "2"]),
        "lang1": _pick("k % 5", ["'slo'", "'eng'", "'cze'", "'ger'", "NULL"]),
        "lang2": _pick("k % 5", ["'eng'", "NULL", "NULL", "'fre'", "NULL"]),
        "vbitrate": "CASE WHEN k % 11 <> 0 THEN INT64(o_totalprice * 60) END",
        "size": "CASE WHEN k % 29 <> 0 THEN INT64(o_totalprice * 40000) END",
        "runtime_ticks": "CASE WHEN k % 31 <> 0 THEN (80 + k % 60) * 600000000 END",
        "date_created": "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 'someday' "
                        "ELSE DAY(o_orderdate) || 'T00:00:00' END",
        "date_modified": "CASE WHEN k % 74 = 0 THEN DAY(o_orderdate) || 'T10:30:00' END",
        "premiere_date": "CASE WHEN k % 3 = 0 THEN DAY(o_orderdate) || 'T00:00:00' END",
        "production_year": "CASE WHEN k % 13 <> 0 THEN cast(extract(year from o_orderdate) as int) END",
        "community_rating": "CASE WHEN k % 7 <> 0 THEN INT64(o_totalprice / 5000) / 10.0 END",
        "critic_rating": "CASE WHEN k % 3 <> 0 THEN cast(k * 37 % 101 as double) END",
        "actor1": "'Actor ' || cast(k % 23 as string)",
        "actor2": "'Actor ' || cast(k % 31 as string)",
        "director": "'Director ' || cast(k % 5 as string)",
        "genre1": _pick("k % 7", ["'Drama'", "'Sci-Fi'", "'Thriller'", "'horor'", "'Weird'", "'sf'", "NULL"]),
        "genre2": _pick("k % 4", ["NULL", "'Suspense'", "'Comedy'", "'dada'"]),
    },
    {
        "name": "'Title ' || cast(c as string)",
        "folder": "CASE WHEN c % 2 = 0 THEN root || '/Title ' || cast(c as string) "
                  "WHEN c % 18 = 3 THEN root || '/Show ' || cast(c as string) || '/Season ' || "
                  "cast(season as string) || '/Title ' || cast(c as string) || ' ' || trim(ep_text) "
                  "ELSE root || '/shared ' || cast(c % 7 as string) END",
        "file": "'Title ' || cast(c as string) || ' ' || ep_text || "
                "CASE WHEN k % 25 < 3 THEN 'dup.mkv' ELSE tag || ' ' || cast(k as string) || '.mkv' END",
    },
    {"path": "folder || '/' || file"},
]

# ------------------------------------------------- series rows (folders), from orders
SERIES_LEVELS: list[Level] = [
    {"c": "o_custkey"},
    {
        "item_id": "'s' || cast(c as string)",
        "type": "'Series'",
        "name": "'Series ' || cast(c as string)",
        "library": "'Lib ' || cast(c % 4 as string)",
        "path": _ROOT + " || '/Show ' || cast(c as string)",
        "imdb": "CASE WHEN c % 6 = 0 THEN 'tt9' || lpad(cast(c as string), 6, '0') END",
        "tmdb": "CASE WHEN c % 12 <> 3 THEN cast(900000 + IDIV(c, 2) as string) END",
        "tvdb": "CASE WHEN c % 9 = 0 THEN cast(700000 + c as string) END",
        "production_year": "CASE WHEN c % 4 <> 0 THEN first_year END",
        "community_rating": "CASE WHEN c % 5 <> 0 THEN cast(c % 100 as double) / 10.0 END",
        "critic_rating": "CASE WHEN c % 4 = 1 THEN cast(c * 7 % 101 as double) END",
        "original_title": "CASE WHEN c % 5 = 0 THEN 'Original ' || cast(c as string) END",
        "sort_name": "CASE WHEN c % 5 < 3 THEN 'sort ' || cast(c as string) END",
        "genre1": _pick("c % 4", ["'Drama'", "'Sci-Fi'", "'Thriller'", "NULL"]),
    },
]

# ------------------------------------------------------------ genre items, from part
GENRE_LEVELS: list[Level] = [
    {"p": "p_partkey"},
    {
        "item_id": "'p' || cast(p as string)",
        "name": "p_name || ' ' || cast(p as string)",
        "type": "CASE WHEN p % 3 = 0 THEN 'Series' ELSE 'Movie' END",
        "tmdb": "CASE WHEN p % 11 <> 0 THEN cast(p as string) END",
        "imdb": "CASE WHEN p % 7 <> 0 THEN 'tt' || lpad(cast(p as string), 7, '0') END",
        "g1": _pick("p % 9", ["NULL", "'Sci-Fi'", "'komédia'", "'Drama'", "'Suspense'", "'Thriller'",
                              "'dada'", "'horor'", "'Weird'"]),
        "g2": _pick("p % 5", ["NULL", "'Thriller'", "'sf'", "NULL", "'Drama'"]),
        "g3": _pick("p % 8", ["'Romantic'", "NULL", "NULL", "'Akcia'", "NULL", "NULL", "'Science Fiction'",
                              "'Mystery'"]),
        "locked": "p % 10 = 0",
    },
]
SNAPSHOT_LEVELS: list[Level] = [
    {"p": "p_partkey"},
    {
        "s1": _pick("p % 6", ["'Action & Adventure'", "'Drama'", "'Sci-Fi & Fantasy'", "'TV Movie'",
                              "'komédia'", "'War & Politics'"]),
        "s2": _pick("p % 7", ["NULL", "'Action'", "'Thriller'", "NULL", "'N/A'", "'Science Fiction'", "'Crime'"]),
        "media_type": "CASE WHEN p % 3 = 0 THEN 'tv' ELSE 'movie' END",
    },
]

# ---------------------------------------------------------------- text, from documents
TEXT_LEVELS: list[Level] = [
    {"d": "doc_id"},
    {
        "item_id": "'d' || cast(d as string)",
        "type": _pick("d % 5", ["'Series'", "'Movie'", "'Episode'", "'Movie'", "'BoxSet'"]),
        "name": "'Name ' || cast(d as string)",
        "overview": "CASE WHEN d % 8 = 0 THEN '' ELSE text END",
        "overview_lang": "CASE WHEN d % 8 <> 0 THEN CASE lang WHEN 'de' THEN 'cs' WHEN 'fr' THEN 'sk' "
                         "ELSE lang END END",
        "tagline": "CASE d % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Tag ' || cast(d as string) END",
        "tagline_lang": "CASE d % 6 WHEN 2 THEN 'sk' WHEN 3 THEN 'cs' WHEN 4 THEN 'en' WHEN 5 THEN 'de' END",
        "title_lang": "CASE d % 7 WHEN 0 THEN 'en' WHEN 1 THEN 'sk' WHEN 2 THEN 'de' WHEN 3 THEN 'fr' "
                      "WHEN 4 THEN 'cs' WHEN 5 THEN 'ja' END",
        "tmdb": "CASE WHEN d % 9 <> 0 THEN cast(d as string) END",
        "production_year": "CASE WHEN d % 4 <> 0 THEN cast(1990 + d % 30 as int) END",
        "series_id": "CASE WHEN d % 5 = 2 AND d % 35 <> 2 THEN 'd' || cast(d - 2 as string) END",
        "season": "CASE WHEN d % 5 = 2 AND d % 45 <> 7 THEN cast(d % 4 as int) END",
        "episode": "CASE WHEN d % 5 = 2 THEN cast(1 + d % 10 as int) END",
        "locks_overview": "d % 13 = 0",
        "locks_name": "d % 14 = 0",
        "locks_tagline": "d % 16 = 3",
    },
]
# one localized entry per document, keyed the way its item looks it up
LOCALIZED_LEVELS: list[Level] = [
    {"d": "doc_id"},
    {
        "key": "CASE d % 5 WHEN 0 THEN 'tv:' || cast(d as string) "
               "WHEN 2 THEN 'ep:' || cast(d - 2 as string) || ':s' || cast(d % 4 as string) || 'e' || "
               "cast(1 + d % 10 as string) "
               "WHEN 4 THEN 'collection:' || cast(d as string) ELSE 'movie:' || cast(d as string) END",
        "negative": "d % 21 = 0",
        "sk_overview": "CASE WHEN d % 3 = 0 THEN 'sk prehľad ' || cast(d as string) ELSE '' END",
        "cs_overview": "CASE WHEN d % 5 < 3 THEN 'cs přehled ' || cast(d as string) END",
        "en_overview": "CASE WHEN d % 2 = 0 THEN 'en overview ' || cast(d as string) ELSE '' END",
        "sk_tagline": "CASE WHEN d % 7 = 0 THEN 'sk heslo ' || cast(d as string) ELSE '' END",
        "cs_tagline": "CASE WHEN d % 11 < 4 THEN 'cs heslo ' || cast(d as string) ELSE '' END",
        "en_tagline": "CASE WHEN d % 4 = 1 THEN 'en tagline ' || cast(d as string) ELSE '' END",
        "en_title": "CASE WHEN d % 5 = 1 THEN 'NAME ' || cast(d as string) WHEN d % 5 = 2 THEN '' "
                    "ELSE 'English ' || cast(d as string) END",
        "year_text": "CASE WHEN d % 6 = 0 THEN '' ELSE cast(1980 + d % 40 as string) END",
        "age_days": "d % 60",
    },
]

# ------------------------------------------------------- file inventory, from documents
INVENTORY_LEVELS: list[Level] = [
    {"d": "doc_id"},
    {
        "path": "'/inv/dir ' || cast(d % 50 as string) || '/file ' || cast(d as string) || '.mkv'",
        "dv_profile": "CASE d % 9 WHEN 0 THEN 5 WHEN 1 THEN 8 END",
        "prev_size": "n_chars",
        "cur_size": "n_chars + CASE WHEN d % 11 = 0 THEN 1 ELSE 0 END",
        "prev_mtime": "cast(d as double) * 1.5",
        "cur_mtime": "cast(d as double) * 1.5 + CASE WHEN d % 13 = 0 THEN 1.0 ELSE 0.0 END",
        "prev_status": "CASE WHEN d % 23 = 0 THEN 'ignored' WHEN d % 29 = 0 THEN 'converted' "
                       "WHEN d % 31 = 0 THEN 'failed' WHEN d % 9 = 0 OR d % 22 = 0 THEN 'needs_rebuild' "
                       "ELSE 'ok' END",
        "prev_fail_count": "cast(d % 4 as int)",
        "prev_first_seen": "CASE WHEN d % 19 <> 0 THEN DAY(TIMESTAMP '2023-05-01 00:00:00') END",
    },
]

# -------------------------------------------------------------- folder rules, from customer
# One rule per customer, for a folder that some of the items lie in, one in six for two folders in a row; four general ones.
FOLDER_RULE_LEVELS: list[Level] = [
    {"c": "c_custkey"},
    {
        "priority": "CASE WHEN c <= 4 THEN 1000000000 + c ELSE c % 1000 END",
        "folders": "CASE WHEN c = 1 THEN '/Movies/4K/' WHEN c = 2 THEN '/Movies/DiViX/' WHEN c = 3 THEN '/data/' WHEN c = 4 THEN '/shared 3/' "
                   "WHEN c % 18 = 3 THEN '/Show ' || cast(c as string) || '/Season 1/' "
                   "WHEN c % 6 = 0 THEN '/Movies/4K/Title ' || cast(c as string) || '/' "
                   "ELSE '/Title ' || cast(c as string) || '/' END",
        "library": "'Shelf ' || cast(CASE WHEN c <= 4 THEN 10 + c ELSE c % 7 END as string)",
    },
]

# ----------------------------------------------------------------- proposals, from customer
PROPOSAL_LEVELS: list[Level] = [
    {"c": "c_custkey"},
    {
        "proposal_id": "cast(c as string)",
        "name": "CASE WHEN c % 10 = 9 THEN 'Title ' || cast(c as string) || ': Extended!' "
                "ELSE 'Title ' || cast(c as string) END",
        "year": "CASE WHEN c % 4 = 0 THEN cast(1995 + c % 7 as int) END",
        "imdb": "CASE WHEN c % 12 = 6 THEN 'TT9' || lpad(cast(c as string), 6, '0') "
                "WHEN c % 4 <> 3 THEN 'tt' || lpad(cast(c * 4 + c % 4 as string), 7, '0') END",
        "tmdb": "CASE WHEN c % 3 = 1 THEN cast(c * 100 + (1 + c % 5) * 10 + 2 as string) "
                "WHEN c % 6 = 3 THEN cast(900000 + IDIV(c, 2) as string) END",
        "tvdb": "CASE WHEN c % 8 = 3 THEN cast(c as string) ELSE '' END",
        "season": "CASE WHEN c % 3 = 0 THEN cast(c % 3 + c % 2 as int) END",
        "episode": "CASE WHEN c % 3 = 0 THEN cast(1 + c % 4 as int) END",
        "resolution": _pick("c % 5", ["'2160p'", "'1080P'", "'720p'", "'480p'", "NULL"]),
        "codec": _pick("c % 4", ["'hevc'", "'h264'", "'av1'", "NULL"]),
        "hdr": _pick("c % 3", ["'HDR10'", "NULL", "'DV'"]),
        "audio": _pick("c % 6", ["'TrueHD Atmos'", "'DTS'", "'AC3 5.1'", "'Stereo'", "NULL", "'AAC'"]),
        "plang1": _pick("c % 4", ["'slo'", "'en'", "'CZE'", "NULL"]),
        "plang2": _pick("c % 6", ["'en'", "NULL", "'de'", "NULL", "NULL", "NULL"]),
        "size_mb": "CASE WHEN c % 7 <> 0 THEN 500 + c * 53 % 30000 END",
        "bitrate_kbps": "CASE WHEN c % 5 <> 1 THEN 800 + c * 97 % 30000 END",
        "path": "CASE WHEN c % 3 <> 1 THEN 'Title.' || cast(c as string) || '.' || "
                + _pick("c % 7", ["'REMUX'", "'BluRay'", "'WEB-DL'", "'HDTV'", "'AI.Upscale'", "'x'", "'WEBRip'"])
                + " || '.mkv' END",
        "source_quality_tier": _pick("c % 4", ["'bluray'", "NULL", "'webdl'", "'bluray_remux'"]),
        "duration_minutes": "CASE WHEN c % 3 = 0 THEN cast(45 + c % 20 as double) "
                            "WHEN c % 3 = 1 THEN cast(90 + c % 60 as double) END",
    },
]

# ------------------------------------------------------------------ popular lists, from part
POPULAR_LEVELS: list[Level] = [
    {"p": "p_partkey"},
    {
        "tmdb_id": "cast(p - p % 4 as string)",
        "source": _pick("p % 3", ["'Top Rated'", "'Popular Now'", "'Trending'"]),
        "source_order": "cast(p % 3 as int)",
        "page": "cast(IDIV(p, 20) as int)",
        "position": "cast(p % 20 as int)",
        "title": "p_name || ' ' || cast(p as string)",
        "year": "CASE WHEN p % 17 = 0 THEN '' ELSE cast(1960 + p_size as string) END",
        "rating": "cast(p * 31 % 101 as double) / 10.0",
        "votes": "p * 17 % 1000",
    },
]

# ------------------------------------------------------------- missing episodes, from lineitem
MISSING_LEVELS: list[Level] = [
    {
        "id": "cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || "
              "cast(l_linenumber as string)",
        "series_id": "'v' || cast(l_suppkey as string)",
        "series_name": "CASE WHEN l_suppkey % 17 <> 0 THEN 'Show ' || cast(l_suppkey as string) END",
        "season": "cast(l_linenumber - 1 as int)",
        "episode": "cast(l_quantity as int)",
        "name": "'Part ' || cast(l_partkey as string)",
        "air_date": "DAY(l_shipdate) || 'T00:00:00'",
        "library": "'Lib ' || cast(l_suppkey % 3 as string)",
    },
]

# -------------------------------------------------------------------- collections, from part
COLLECTION_LEVELS: list[Level] = [
    {
        "collection_id": "p_brand",
        "collection_name": "p_brand || ' Collection'",
        "part_id": "cast(p_partkey as string)",
        "title": "p_name || ' ' || cast(p_partkey as string)",
        "release_date": "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'TBA' "
                        "ELSE cast(1990 + p_size as string) || '-06-15' END",
        "owned": "p_partkey % 3 <> 0",
    },
]


def _duck_views() -> dict[str, str]:
    series_source = (
        "(SELECT o_custkey, cast(min(extract(year from o_orderdate)) as int) AS first_year, "
        "count(*) AS n_orders FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey)"
    )
    return {
        "b_items": _duck_levels("orders", ITEM_LEVELS),
        "b_series": _duck_levels(series_source, SERIES_LEVELS),
        "b_user_data": (
            "SELECT cast(l_suppkey as string) AS user_id, cast(l_orderkey as string) AS item_id, "
            "l_returnflag = 'R' AND l_linenumber = 1 AS played, l_linenumber = 7 AS is_favorite, "
            "CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS position_ticks FROM lineitem"
        ),
        "b_series_user_data": (
            "SELECT cast(o_orderkey % 10 as string) AS user_id, 's' || cast(o_custkey as string) AS item_id, "
            "o_orderkey % 200 = 0 AS played, o_orderkey % 160 = 7 AS is_favorite, "
            "CASE WHEN o_orderkey % 40 = 1 THEN cast(o_orderkey % 9 as int) END AS unplayed_item_count "
            "FROM orders WHERE o_custkey % 3 = 0"
        ),
        "b_playback": (
            "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'playback.stop' "
            "ELSE 'playback.start' END AS type, "
            "make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 10) "
            "- to_years(cast(user_id % 3 as int)) AS ts, cast(user_id as string) AS user_id, "
            "cast(k % 3 as string) AS item_id, CASE WHEN k % 2 = 0 THEN 'Show S01, Ep02 ' || "
            "cast(k as string) ELSE 'Film ' || cast(k as string) END AS name FROM "
            "(SELECT *, cast(json_extract_string(props, '$.k') as bigint) AS k FROM events "
            "WHERE event_type IN ('view', 'click', 'purchase'))"
        ),
        "b_users": "SELECT cast(s_suppkey as string) AS user_id, s_name AS user_name FROM supplier",
        "b_missing": _duck_levels("lineitem", MISSING_LEVELS),
        "b_genres": _duck_levels("part", GENRE_LEVELS),
        "b_snapshot_src": _duck_levels("part", SNAPSHOT_LEVELS),
        "b_text": _duck_levels("documents", TEXT_LEVELS),
        "b_localized": _duck_levels("documents", LOCALIZED_LEVELS),
        "b_inventory": _duck_levels("documents", INVENTORY_LEVELS),
        "b_proposals": _duck_levels("customer", PROPOSAL_LEVELS),
        "b_folder_rules": _duck_levels("customer", FOLDER_RULE_LEVELS),
        "b_popular": _duck_levels("part", POPULAR_LEVELS),
        "b_collections": _duck_levels("part", COLLECTION_LEVELS),
    }


DUCK_VIEWS = _duck_views()


class Bridge:
    """Catalogue views over one folder of tables; every view is built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        """One supplied table, spread over the cores when it is a single small split.

        Each supplied table is one file of one row group, which a single task would read and
        then work through alone. A table of many splits is left as it is.
        """
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @staticmethod
    def _provider_map(*providers: str):
        """Map of the non-null ids; the spelling of the keys alternates between rows."""
        entries = []
        for i, (name, key) in enumerate(p.split(":") for p in providers):
            spelled = F.when(F.col("_odd"), F.lit(key.upper() if i % 2 == 0 else key.lower())).otherwise(
                F.lit(key)
            )
            entries.append(F.struct(spelled.alias("key"), F.col(name).alias("value")))
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    @cached_property
    def items(self) -> DataFrame:
        df = _spark_levels(self.table("orders"), ITEM_LEVELS)
        null_s = F.lit(None).cast("string")
        stream = "type codec width height bit_rate bit_depth video_range dv_subtype dv_desc channels language display_language".split()

        def make_stream(**values):
            types = {"width": "int", "height": "int", "bit_rate": "bigint", "bit_depth": "int", "channels": "int"}
            return F.struct(*[
                values.get(n, null_s).cast(types.get(n, "string")).alias(n) for n in stream
            ])

        video = make_stream(
            type=F.lit("Video"), codec=F.col("vcodec"), width=F.col("width"), height=F.col("height"),
            bit_rate=F.col("vbitrate"), video_range=F.col("video_range"),
            dv_subtype=F.col("dv_subtype"), dv_desc=F.col("dv_desc"),
        )
        audio1 = make_stream(type=F.lit("Audio"), codec=F.col("acodec"), channels=F.col("channels"),
                             language=F.col("lang1"))
        audio2 = make_stream(type=F.lit("Audio"), codec=F.lit("aac"), channels=F.lit(2),
                             language=F.col("lang2"))
        streams = F.when(F.col("lang2").isNull(), F.array(video, audio1)).otherwise(
            F.array(video, audio1, audio2)
        )
        genres = F.filter(F.array("genre1", "genre2"), lambda g: g.isNotNull())
        people = F.array(*[
            F.struct(F.col(c).alias("name"), F.lit(t).alias("type"))
            for c, t in (("actor1", "Actor"), ("actor2", "Actor"), ("director", "Director"))
        ])
        return df.withColumn("_odd", F.col("k") % 2 == 1).select(
            "k", "c", "item_id", "type", "name", "path", F.lit("srv").alias("server_id"), "library",
            F.lit(False).alias("is_folder"),
            self._provider_map("imdb:Imdb", "tmdb:Tmdb", "tvdb:Tvdb", "tmdbcollection:TmdbCollection").alias("provider_ids"),
            "series_id", "series_name", "season", "episode", "date_created", "date_modified",
            "premiere_date", null_s.alias("end_date"), "production_year",
            F.col("runtime_ticks").cast("bigint").alias("runtime_ticks"), "size",
            F.col("vbitrate").alias("bitrate"), F.col("community_rating").cast("double").alias("community_rating"),
            "critic_rating", genres.alias("genres"), people.alias("people"), streams.alias("media_streams"),
        )

    @cached_property
    def series(self) -> DataFrame:
        source = (
            self.table("orders").where("o_custkey % 3 = 0").groupBy("o_custkey")
            .agg(F.min(F.year("o_orderdate")).alias("first_year"), F.count("*").alias("n_orders"))
        )
        df = _spark_levels(source, SERIES_LEVELS)
        return df.withColumn("_odd", F.col("c") % 2 == 1).select(
            "c", "item_id", "type", "name", "library", "path", F.lit(True).alias("is_folder"),
            self._provider_map("imdb:Imdb", "tmdb:Tmdb", "tvdb:Tvdb").alias("provider_ids"),
            "production_year", "community_rating", "critic_rating", "original_title", "sort_name",
            F.col("n_orders").cast("int").alias("recursive_item_count"),
            F.filter(F.array("genre1"), lambda g: g.isNotNull()).alias("genres"),
            F.concat(F.col("first_year").cast("string"), F.lit("-01-01T00:00:00")).alias("date_created"),
        )

    @cached_property
    def folder_rules(self) -> DataFrame:
        return _spark_levels(self.table("customer"), FOLDER_RULE_LEVELS).select("priority", "folders", "library")

    @cached_property
    def user_data(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "cast(l_suppkey as string) AS user_id", "cast(l_orderkey as string) AS item_id",
            "l_returnflag = 'R' AND l_linenumber = 1 AS played", "l_linenumber = 7 AS is_favorite",
            "cast(if(l_linenumber = 6, 1, 0) as bigint) AS position_ticks",
        )

    @cached_property
    def series_user_data(self) -> DataFrame:
        return self.table("orders").where("o_custkey % 3 = 0").selectExpr(
            "cast(o_orderkey % 10 as string) AS user_id", "'s' || cast(o_custkey as string) AS item_id",
            "o_orderkey % 200 = 0 AS played", "o_orderkey % 160 = 7 AS is_favorite",
            "CASE WHEN o_orderkey % 40 = 1 THEN cast(o_orderkey % 9 as int) END AS unplayed_item_count",
        )

    @cached_property
    def activity(self) -> DataFrame:
        """All events as activity rows; playback rows are a part of them."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        micros = F.unix_micros(F.col("ts").cast("timestamp"))
        moved = F.timestamp_micros(F.expr("1704067200000000 + (micros - 1704067200000000) div 10"))
        return (
            self.table("events").withColumn("k", k).withColumn("micros", micros)
            .select(
                "event_id",
                F.expr("CASE WHEN event_type = 'purchase' THEN 'playback.stop' "
                       "WHEN event_type IN ('view', 'click') THEN 'playback.start' "
                       "ELSE event_type END").alias("type"),
                (moved - F.expr("make_ym_interval(cast(user_id % 3 as int), 0)")).alias("ts"),
                F.col("user_id").cast("string").alias("user_id"),
                F.expr("cast(k % 3 as string)").alias("item_id"),
                F.expr("CASE WHEN k % 2 = 0 THEN 'Show S01, Ep02 ' || cast(k as string) "
                       "ELSE 'Film ' || cast(k as string) END").alias("name"),
            )
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.table("supplier").selectExpr("cast(s_suppkey as string) AS user_id", "s_name AS user_name")

    @cached_property
    def missing(self) -> DataFrame:
        return _spark_levels(self.table("lineitem"), MISSING_LEVELS).select(
            "id", "series_id", "series_name", "season", "episode", "name", "air_date", "library",
        )

    @cached_property
    def genre_items(self) -> DataFrame:
        df = _spark_levels(self.table("part"), GENRE_LEVELS)
        genres = F.filter(F.array("g1", "g2", "g3"), lambda g: g.isNotNull())
        return df.withColumn("_odd", F.lit(False)).select(
            "p", "item_id", "name", "type",
            self._provider_map("tmdb:Tmdb", "imdb:Imdb").alias("provider_ids"),
            genres.alias("genres"),
            F.transform(genres, lambda g: F.struct(g.alias("name"))).alias("genre_items"),
            F.when(F.col("locked"), F.array(F.lit("Name"))).otherwise(F.array().cast("array<string>")).alias("locked_fields"),
        )

    @cached_property
    def snapshot_source(self) -> DataFrame:
        return _spark_levels(self.table("part"), SNAPSHOT_LEVELS)

    @cached_property
    def genre_snapshot(self) -> DataFrame:
        df = self.snapshot_source
        names = F.filter(F.array("s1", "s2"), lambda g: g.isNotNull())
        first = df.where("p % 4 <> 0").select(
            F.lit("tmdb").alias("provider"), F.col("p").cast("string").alias("external_id"),
            "media_type", names.alias("genres"),
        )
        second = df.where("p % 5 = 0").select(
            F.lit("omdb").alias("provider"),
            F.concat(F.lit("tt"), F.lpad(F.col("p").cast("string"), 7, "0")).alias("external_id"),
            F.lit(None).cast("string").alias("media_type"),
            F.filter(F.array("s2", F.lit("Thriller")), lambda g: g.isNotNull()).alias("genres"),
        )
        return first.unionByName(second)

    @cached_property
    def text_items(self) -> DataFrame:
        df = _spark_levels(self.table("documents"), TEXT_LEVELS)
        locks = F.filter(
            F.array(*[F.when(F.col(c), F.lit(v)) for c, v in (
                ("locks_overview", "Overview"), ("locks_name", "Name"), ("locks_tagline", "Tagline"))]),
            lambda x: x.isNotNull(),
        )
        return df.withColumn("_odd", F.lit(False)).select(
            "d", "item_id", "type", "name", "overview", "overview_lang",
            F.when(F.col("tagline").isNull(), F.array().cast("array<string>")).otherwise(F.array("tagline")).alias("taglines"),
            "tagline_lang", "title_lang", self._provider_map("tmdb:Tmdb").alias("provider_ids"),
            "production_year", "series_id", "season", "episode", locks.alias("locked_fields"),
        )

    @cached_property
    def localized(self) -> DataFrame:
        df = _spark_levels(self.table("documents"), LOCALIZED_LEVELS)

        def entry(lang: str, overview: str, tagline: str, title, year):
            body = F.struct(title.alias("title"), F.col(overview).alias("overview"),
                            F.col(tagline).alias("tagline"), year.alias("year"))
            return F.struct(F.lit(lang).alias("key"), body.alias("value"))

        blank = F.lit("")
        localized = F.map_from_entries(F.array(
            entry("en-US", "en_overview", "en_tagline", F.col("en_title"), F.col("year_text")),
            entry("cs-CZ", "cs_overview", "cs_tagline", blank, blank),
            entry("sk-SK", "sk_overview", "sk_tagline", blank, F.col("year_text")),
        ))
        return df.select(
            "key", F.when(~F.col("negative"), localized).alias("localized"),
            F.expr("timestamp'2024-12-31 00:00:00' - make_interval(0, 0, 0, cast(age_days as int))").alias("fetched_at"),
        )

    @cached_property
    def _inventory(self) -> DataFrame:
        return _spark_levels(self.table("documents"), INVENTORY_LEVELS)

    @cached_property
    def inventory_state(self) -> DataFrame:
        return self._inventory.where("d % 7 <> 0").selectExpr(
            "path", "prev_size AS size", "prev_mtime AS mtime", "dv_profile", "prev_status AS status",
            "cast(prev_first_seen as timestamp) AS first_seen",
            "timestamp'2023-06-01 00:00:00' AS last_checked", "prev_fail_count AS fail_count",
        )

    @cached_property
    def inventory_scan(self) -> DataFrame:
        """Current files with the probe verdict: side data entries as a probe lists them."""
        return self._inventory.where("d % 5 <> 0").selectExpr(
            "path", "cur_size AS size", "cur_mtime AS mtime",
            "CASE WHEN dv_profile IS NULL THEN array() ELSE array(named_struct('dv_profile', cast(null as int)), "
            "named_struct('dv_profile', cast(dv_profile as int))) END AS side_data",
        )

    @cached_property
    def proposals(self) -> DataFrame:
        df = _spark_levels(self.table("customer"), PROPOSAL_LEVELS)
        langs = F.filter(F.array("plang1", "plang2"), lambda x: x.isNotNull())
        return df.withColumn("audio_languages", langs).drop("plang1", "plang2", *self.table("customer").columns)

    @cached_property
    def popular(self) -> DataFrame:
        return _spark_levels(self.table("part"), POPULAR_LEVELS).select(
            "p", "tmdb_id", "source", "source_order", "page", "position", "title", "year", "rating", "votes",
        )

    @cached_property
    def collection_parts(self) -> DataFrame:
        return _spark_levels(self.table("part"), COLLECTION_LEVELS).select(
            "collection_id", "collection_name", "part_id", "title", "release_date", "owned",
        )

    @cached_property
    def owned_movies(self) -> DataFrame:
        """Distinct provider ids of owned movies with their titles."""
        return self.collection_parts.where("owned").selectExpr("part_id AS tmdb_id", "'My ' || title AS name")

    @cached_property
    def item_added(self) -> DataFrame:
        """Webhook bodies: JSON in two spellings, and text that is no JSON.

        Stored bodies are what the parser meets, so they are written once: else their making
        would be repeated in every expression that reads them.
        """
        event = F.expr(
            "CASE event_type WHEN 'view' THEN 'library.new' WHEN 'click' THEN 'Item.Added' "
            "WHEN 'purchase' THEN 'itemadded' WHEN 'signup' THEN 'system.itemadded' ELSE 'playback.start' END"
        )
        item = F.struct(
            F.when(F.col("event_id") % 3 == 0, F.lit("Episode")).otherwise(F.lit("Movie")).alias("Type"),
            F.when(F.col("event_id") % 50 != 0, (F.col("event_id") % 400).cast("string")).alias("Id"),
            F.concat(F.lit("Item "), (F.col("event_id") % 400).cast("string"), F.lit(" v"),
                     F.col("event_id").cast("string")).alias("Name"),
            F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("SeriesId"),
            F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Series "), F.col("user_id").cast("string"))).alias("SeriesName"),
        )
        upper = F.to_json(F.struct(event.alias("Event"), item.alias("Item")))
        lower = F.to_json(F.struct(event.alias("event"), item.alias("Metadata")))
        raw = F.concat(F.lit("--form\r\n"), upper, F.lit("\r\n--"))
        body = F.when(F.col("event_id") % 7 == 0, raw).when(F.col("event_id") % 2 == 0, upper).otherwise(lower)
        rows = self.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))
        return cut_lineage(rows)
