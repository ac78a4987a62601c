"""Queries of the genre family."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.operators import genres as G
from reelwright.session import checkpoint_dir
from verification.bridge import Bridge
from verification.registry import fragment, query

_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in K.GENRE_ALIASES.items()) + "}"


def _canon(x: str) -> str:
    return f"coalesce({_ALIAS}[lower({x})], {x})"


def _distinct(x: str) -> str:
    """Ordered distinct of a list expression."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


fragment("o_g", "SELECT *, list_filter([g1, g2, g3], lambda v: v IS NOT NULL) AS genres FROM b_genres")
fragment("o_gn", f"SELECT *, list_transform(genres, lambda v: {_canon('v')}) AS mapped FROM o_g")
fragment("o_gx", f"SELECT *, {_distinct('mapped')} AS normal FROM o_gn")
fragment("o_gcount", f"""SELECT genre, {_canon('genre')} AS canonical, count(*) AS n_items FROM (SELECT unnest(genres) AS genre FROM o_g) GROUP BY ALL""")
fragment("o_snap", f"""SELECT provider, external_id, media_type, {_distinct('parts')} AS genres FROM (SELECT *, flatten(list_transform(
list_filter(names, lambda v: v IS NOT NULL AND v NOT IN ('TV Movie', 'TV Film', 'N/A', '')), lambda v: CASE v WHEN 'Action & Adventure' THEN ['Action', 'Adventure']
WHEN 'Sci-Fi & Fantasy' THEN ['Science Fiction', 'Fantasy'] WHEN 'War & Politics' THEN ['War'] ELSE [{_canon('v')}] END)) AS parts FROM
(SELECT 'tmdb' AS provider, p::varchar AS external_id, media_type, [s1, s2] AS names FROM b_snapshot_src WHERE p % 4 <> 0
UNION ALL SELECT 'omdb', 'tt' || lpad(p::varchar, 7, '0'), NULL, [s2, 'Thriller'] FROM b_snapshot_src WHERE p % 5 = 0))""")


def _external(source: str) -> str:
    return f"""SELECT i.*, CASE WHEN len(t.genres) > 0 THEN t.genres WHEN len(o.genres) > 0 THEN o.genres ELSE [] END AS ext FROM {source} i
LEFT JOIN (SELECT * FROM o_snap WHERE provider = 'tmdb') t ON t.external_id = i.tmdb AND t.media_type = CASE WHEN i.type = 'Series' THEN 'tv' ELSE 'movie' END
LEFT JOIN (SELECT * FROM o_snap WHERE provider = 'omdb') o ON o.external_id = i.imdb"""


def _compared(source: str) -> str:
    return f"""SELECT *, list_sort(list_filter(ext, lambda v: NOT list_contains(normal, v))) AS missing,
list_sort(list_filter(normal, lambda v: NOT list_contains(ext, v))) AS extra, list_sort(list_distinct(list_concat(normal, ext))) AS merged FROM ({source})"""


fragment("o_ext", _external("o_gx"))
fragment("o_cmp", _compared("SELECT * FROM o_ext"))
_J = "array_to_string({0}, '|')"
_STATUS = "CASE WHEN len(ext) = 0 THEN 'no_data' WHEN len(missing) = 0 THEN 'no_diff' ELSE '{0}' END"


def _join(c):
    return F.array_join(c, "|")


@query("scan_genres", "SELECT DISTINCT genre FROM o_gcount")
def _(b: Bridge):
    from reelwright.sources.catalogue import scan_genres

    return scan_genres(b.genre_items)


@query("normalize_genre", "SELECT genre, canonical, n_items, canonical <> genre AS is_variant FROM o_gcount")
def _(b: Bridge):
    return G.genre_counts(b.genre_items)


@query("normalize_genres_array", f"SELECT item_id, {_J.format('normal')} AS normal, normal <> genres OR len(genres) <> len(list_distinct(genres)) AS candidate FROM o_gx")
def _(b: Bridge):
    return b.genre_items.select("item_id", _join(G.normalize_genres(F.col("genres"))).alias("normal"),
                                G.needs_normalizing(F.col("genres"), F.col("genre_items")).alias("candidate"))


@query("genre_audit", """SELECT count(*) AS total_items, count(*) FILTER (len(genres) = 0) AS total_without_genres,
count(*) FILTER (mapped <> genres) AS normalization_candidates, round(count(*) FILTER (len(genres) = 0) / count(*) * 100, 6) AS pct_without FROM o_gx""")
def _(b: Bridge):
    return G.genre_audit(b.genre_items).withColumn("pct_without", F.round("pct_without", 6))


@query("genre_audit_candidates", f"SELECT item_id, {_J.format('genres')} AS current, {_J.format('mapped')} AS suggested FROM o_gx WHERE mapped <> genres")
def _(b: Bridge):
    return G.normalization_candidates(b.genre_items).select(
        "item_id", _join("current_genres").alias("current"), _join("suggested_genres").alias("suggested"))


@query("genre_variant_groups", """SELECT canonical, count(*) AS n_variants, sum(n_items)::bigint AS n_items, string_agg(lower(genre), '|' ORDER BY lower(genre)) AS variants
FROM o_gcount WHERE canonical <> genre GROUP BY 1""")
def _(b: Bridge):
    return G.variant_groups(b.genre_items).withColumn("variants", _join("variants"))


@query("variant_mapping_counts", "SELECT genre AS variant, canonical, n_items FROM o_gcount WHERE canonical <> genre")
def _(b: Bridge):
    return G.variant_mapping_counts(b.genre_items)


_CANONICAL = "[" + ", ".join(f"'{n}'" for n in K.CANONICAL_GENRES) + "]"


@query("suggest_mappings", f"""SELECT g.genre, g.n_items, coalesce(string_agg(name, '|' ORDER BY likeness DESC, name) FILTER (place <= 3), '') AS suggestions FROM
(SELECT genre, sum(n_items)::bigint AS n_items FROM o_gcount WHERE NOT list_contains({_CANONICAL}, genre) AND NOT list_contains(map_keys({_ALIAS}), lower(genre)) GROUP BY 1) g LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY genre ORDER BY likeness DESC, name) AS place FROM
(SELECT genre, name, 1 - levenshtein(genre, name) / greatest(length(genre), length(name)) AS likeness FROM (SELECT DISTINCT genre FROM o_gcount), (SELECT unnest({_CANONICAL}) AS name))
WHERE likeness >= 0.5) USING (genre) GROUP BY ALL""")
def _(b: Bridge):
    return G.suggest_mappings(b.genre_items).withColumn("suggestions", _join("suggestions"))


@query("repair_duplicate_genres", f"""SELECT item_id, {_J.format(_distinct('genres'))} AS repaired, len(list_distinct(genres)) < len(genres) AS had_duplicates FROM o_g""")
def _(b: Bridge):
    return G.repair_duplicate_genres(b.genre_items).select("item_id", _join("repaired").alias("repaired"), "had_duplicates")


@query("normalize_genres_run", """SELECT status, count(*) AS n_items FROM (SELECT CASE WHEN normal = genres AND len(genres) = len(list_distinct(genres)) THEN 'clean'
WHEN list_sort(genres) <> list_sort(normal) THEN 'updated' ELSE 'skipped' END AS status FROM o_gx) GROUP BY 1""")
def _(b: Bridge):
    return G.run_counters(G.normalize_genres_run(b.genre_items))


@query("expand_compound_genres", f"SELECT provider, external_id, {_J.format('genres')} AS genres FROM o_snap")
def _(b: Bridge):
    return b.genre_snapshot.select("provider", "external_id", _join(G.expand_compound_genres(F.col("genres"))).alias("genres"))


@query("provider_fallback", f"SELECT item_id, {_J.format('ext')} AS external FROM o_ext")
def _(b: Bridge):
    return G.provider_fallback(b.genre_items, b.genre_snapshot).select("item_id", _join("external").alias("external"))


@query("compare_genres", f"SELECT item_id, {_J.format('missing')} AS missing, {_J.format('extra')} AS extra, {_J.format('merged')} AS merged, len(missing) > 0 AS has_diff FROM o_cmp")
def _(b: Bridge):
    rows = G.provider_fallback(b.genre_items, b.genre_snapshot).withColumn("c", G.compare_genres(F.col("genres"), F.col("external")))
    return rows.select("item_id", _join("c.missing").alias("missing"), _join("c.extra").alias("extra"),
                       _join("c.merged").alias("merged"), "c.has_diff")


@query("fix_genres", f"""SELECT 'gaps_only' AS mode, {_STATUS.format('dry_run')} AS status, count(*) AS n, count(*) FILTER (len(missing) > 1) AS n_many FROM o_cmp WHERE len(genres) = 0 GROUP BY ALL
UNION ALL SELECT 'validate', {_STATUS.format('dry_run')}, count(*), count(*) FILTER (len(missing) > 1) FROM o_cmp GROUP BY ALL""")
def _(b: Bridge):
    def counted(mode: str):
        rows = G.fix_genres(b.genre_items, b.genre_snapshot, mode).withColumn("mode", F.lit(mode))
        return rows.groupBy("mode", "status").agg(F.count("*").alias("n"), F.count_if(F.size("added") > 1).alias("n_many"))

    return counted("gaps_only").unionByName(counted("validate"))


@query("process_genres", f"""SELECT item_id, list_sort(genres) <> list_sort(normal) AS was_normalized, {_STATUS.format('updated')} AS status,
CASE WHEN len(missing) > 0 THEN {_J.format('merged')} END AS new_genres FROM o_cmp WHERE p % 2 = 0""")
def _(b: Bridge):
    ids = b.genre_items.where("p % 2 = 0").select("item_id")
    return G.process_genres(b.genre_items, b.genre_snapshot, ids).select(
        "item_id", "was_normalized", "status", _join("new_genres").alias("new_genres"))


@query("apply_genre_update", f"""SELECT item_id, {_J.format('genres')} AS old_genres, {_J.format('normal')} AS new_genres,
CASE WHEN p % 10 = 0 THEN 'Name|Genres' ELSE 'Genres' END AS locks FROM o_gx WHERE list_sort(genres) <> list_sort(normal)""")
def _(b: Bridge):
    return G.apply_genre_update(b.genre_items, G.normalize_genres(F.col("genres"))).select(
        "item_id", _join("old_genres").alias("old_genres"), _join("new_genres").alias("new_genres"),
        _join("new_locked_fields").alias("locks"))


# ------------------------------------------------------------------------ keyed store
#: Entries by part: those of every third are 40 days old, every fourth is known to have no genres, and a later
#: fetch replaces every seventh. The store is asked at the end of 2024.
STORE_AS_OF = "2024-12-31 00:00:00"
fragment("o_store", """SELECT *, CASE WHEN p % 7 = 0 THEN 1 WHEN p % 3 = 0 THEN 40 ELSE 5 END AS age_days,
CASE WHEN p % 7 = 0 THEN ['Drama'] WHEN p % 4 = 0 THEN [] ELSE list_filter([s1, s2], lambda v: v IS NOT NULL) END AS names FROM b_snapshot_src WHERE p % 5 <> 1""")
fragment("o_store_asked", """SELECT item_id, 'tmdb_' || tmdb || '_' || CASE WHEN type = 'Series' THEN 'tv' ELSE 'movie' END AS key FROM o_gx WHERE tmdb <> ''
UNION ALL SELECT item_id, 'omdb_' || imdb FROM o_gx WHERE imdb <> ''""")
fragment("o_store_found", """SELECT a.item_id, a.key, CASE WHEN s.key IS NULL THEN 'missing' WHEN age_days >= 30 THEN 'stale' WHEN len(names) = 0 THEN 'negative' ELSE 'fresh' END AS status, names
FROM o_store_asked a LEFT JOIN (SELECT 'tmdb_' || p || '_' || media_type AS key, names, age_days FROM o_store) s USING (key)""")


def _store(b: Bridge):
    """A keyed store filled by two fetches, read back."""
    from reelwright.sources import snapshots

    path = f"{checkpoint_dir(b.spark)}/store-{uuid.uuid4().hex}"
    source = b.snapshot_source.where("p % 5 <> 1")
    key = snapshots.store_key(F.lit("tmdb"), F.col("p").cast("string"), F.col("media_type"))
    names = F.when(F.col("p") % 4 == 0, F.array().cast("array<string>")).otherwise(F.filter(F.array("s1", "s2"), lambda g: g.isNotNull()))
    day = F.to_timestamp(F.lit(STORE_AS_OF))
    fetched = day - F.when(F.col("p") % 3 == 0, F.expr("INTERVAL 40 DAYS")).otherwise(F.expr("INTERVAL 5 DAYS"))
    first = source.select(F.lit("genres").alias("namespace"), key.alias("key"), names.alias("value"), fetched.alias("fetched_at"))
    later = source.where("p % 7 = 0").select(F.lit("genres").alias("namespace"), key.alias("key"), F.array(F.lit("Drama")).alias("value"),
                                              (day - F.expr("INTERVAL 1 DAYS")).alias("fetched_at"))
    snapshots.merge_store(path, first)
    snapshots.merge_store(path, later)
    snapshots.merge_store(path, later.withColumn("namespace", F.lit("texts")))  # another namespace may use the same keys
    return snapshots.read_store(b.spark, path)


@query("genre_store", f"SELECT item_id, key, status, CASE WHEN status = 'fresh' THEN {_J.format('names')} END AS value FROM o_store_found")
def _(b: Bridge):
    """Every lookup that the items' genres need, as the store answers it."""
    from reelwright.sources.snapshots import look_up

    found = look_up(G.genre_requests(b.genre_items), _store(b), STORE_AS_OF)
    return found.select("item_id", "key", "status", _join("value").alias("value"))


@query("genre_store_fallback", f"""SELECT DISTINCT i.item_id, coalesce({_J.format(_distinct("flatten(list_transform(list_filter(names, lambda v: v NOT IN ('TV Movie', 'TV Film', 'N/A', '')), lambda v: CASE v WHEN 'Action & Adventure' THEN ['Action', 'Adventure'] WHEN 'Sci-Fi & Fantasy' THEN ['Science Fiction', 'Fantasy'] WHEN 'War & Politics' THEN ['War'] ELSE [" + _canon('v') + "] END))"))}, '') AS external
FROM o_gx i LEFT JOIN (SELECT * FROM o_store_found WHERE status = 'fresh' AND key LIKE 'tmdb%') f USING (item_id)""")
def _(b: Bridge):
    """The provider fallback over fresh entries of the store only."""
    snapshot = G.stored_snapshot(b.genre_items, _store(b), STORE_AS_OF)
    return G.provider_fallback(b.genre_items, snapshot).select("item_id", _join("external").alias("external"))


@query("genre_store_fetches", "SELECT DISTINCT key FROM o_store_found WHERE status IN ('missing', 'stale')")
def _(b: Bridge):
    return G.to_fetch(b.genre_items, _store(b), STORE_AS_OF).select("key")
