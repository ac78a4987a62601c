"""Explicit table schemas; nothing is inferred from data."""

ITEMS = """
item_id string, type string, name string, path string, server_id string, library string,
is_folder boolean, provider_ids map<string,string>,
series_id string, series_name string, season int, episode int,
date_created string, date_modified string, premiere_date string, end_date string,
production_year int, runtime_ticks bigint, size bigint, bitrate bigint,
community_rating double, critic_rating double, recursive_item_count int,
genres array<string>, genre_items array<struct<name:string>>, locked_fields array<string>,
overview string, taglines array<string>, original_title string, sort_name string,
people array<struct<name:string,type:string>>,
media_streams array<struct<type:string,codec:string,width:int,height:int,bit_rate:bigint,
bit_depth:int,video_range:string,dv_subtype:string,dv_desc:string,channels:int,
language:string,display_language:string>>
""".replace("\n", " ")

USER_DATA = (
    "user_id string, item_id string, played boolean, is_favorite boolean, "
    "position_ticks bigint, unplayed_item_count int"
)

PLAYBACK = (
    "event_id bigint, type string, ts timestamp, user_id string, item_id string, name string"
)

MISSING_EPISODES = (
    "id string, series_id string, series_name string, original_series_name string, "
    "season int, episode int, name string, air_date string, overview string"
)

PROPOSALS = (
    "proposal_id string, name string, year int, imdb string, tmdb string, tvdb string, "
    "season int, episode int, resolution string, codec string, hdr string, audio string, "
    "audio_languages array<string>, size_mb bigint, bitrate_kbps bigint, path string, "
    "source_quality_tier string, duration_minutes double"
)

GENRE_SNAPSHOT = (
    "provider string, external_id string, media_type string, genres array<string>, "
    "fetched_at timestamp"
)

LOCALIZED_SNAPSHOT = (
    "key string, "
    "localized map<string,struct<title:string,overview:string,tagline:string,year:string>>, "
    "fetched_at timestamp"
)

COLLECTIONS = (
    "collection_id string, name string, "
    "parts array<struct<id:string,title:string,release_date:string>>"
)

INVENTORY = (
    "path string, size bigint, mtime double, dv_profile int, status string, "
    "first_seen timestamp, last_checked timestamp, fail_count int"
)

ITEM_ADDED = "ts timestamp, body string"
