"""Genre clean-up: canonical names, audit, provider lookups and additive merges."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.constants import SNAPSHOT_TTL_SECONDS
from reelwright.functions.util import literal_map, provider_id, string_array
from reelwright.sources.snapshots import look_up, store_key

# ------------------------------------------------------------------------ expressions


def normalize_genre(genre: Column) -> Column:
    """Canonical name of a known spelling in any case, else the name as it is."""
    return F.coalesce(F.try_element_at(literal_map(K.GENRE_ALIASES), F.lower(genre)), genre)


def _known(genres: Column) -> Column:
    return F.coalesce(genres, F.array().cast("array<string>"))


def normalize_genres(genres: Column) -> Column:
    """Canonical names, first mention first, repeats dropped."""
    return F.array_distinct(F.transform(_known(genres), normalize_genre))


def needs_normalizing(genres: Column, genre_items: Column) -> Column:
    names = F.transform(F.coalesce(genre_items, F.array().cast("array<struct<name:string>>")), lambda g: g["name"])
    repeated = F.size(names) != F.size(F.array_distinct(names))
    return (normalize_genres(genres) != _known(genres)) | repeated


def expand_compound_genres(names: Column) -> Column:
    """Provider genres: compounds split, empty names skipped, the rest canonical."""
    compounds = F.create_map(*[
        x for name, parts in K.COMPOUND_GENRES.items() for x in (F.lit(name), string_array(parts))
    ])
    kept = F.filter(_known(names), lambda g: ~g.isin(*K.SKIPPED_GENRES))
    parts = F.transform(
        kept, lambda g: F.coalesce(F.try_element_at(compounds, g), F.array(normalize_genre(g)))
    )
    return F.array_distinct(F.flatten(parts))


def split_genre_text(text: Column) -> Column:
    """Comma-separated provider genres, trimmed, skipped and canonical."""
    names = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda g: F.trim(g))
    kept = F.filter(names, lambda g: ~g.isin(*K.SKIPPED_GENRES))
    return F.array_distinct(F.transform(kept, normalize_genre))


def compare_genres(own: Column, external: Column) -> Column:
    """struct(missing, extra, merged, has_diff) of two genre lists, canonical and sorted."""
    mine, theirs = normalize_genres(own), normalize_genres(external)
    missing = F.array_sort(F.array_except(theirs, mine))
    return F.struct(
        missing.alias("missing"),
        F.array_sort(F.array_except(mine, theirs)).alias("extra"),
        F.array_sort(F.array_union(mine, theirs)).alias("merged"),
        (F.size(missing) > 0).alias("has_diff"),
    )


# ------------------------------------------------------------------------------ audit


def genre_counts(items: DataFrame) -> DataFrame:
    """Mentions per genre, with the canonical name and whether it differs."""
    counts = items.select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("n_items"))
    canonical = normalize_genre(F.col("genre"))
    return counts.select("genre", "n_items", canonical.alias("canonical"), (canonical != F.col("genre")).alias("is_variant"))


def genre_audit(items: DataFrame) -> DataFrame:
    """One row of totals: items, items without genres and their share, items to normalise."""
    own = _known(F.col("genres"))
    changed = F.exists(own, lambda g: normalize_genre(g) != g)
    totals = items.agg(
        F.count("*").alias("total_items"),
        F.count_if(F.size(own) == 0).alias("total_without_genres"),
        F.count_if(changed).alias("normalization_candidates"),
    )
    share = F.col("total_without_genres") / F.nullif("total_items", F.lit(0)) * 100.0
    return totals.withColumn("pct_without", F.coalesce(share, F.lit(0.0)))


def normalization_candidates(items: DataFrame) -> DataFrame:
    """Items with a variant spelling, their genres and the suggested ones."""
    suggested = F.transform(_known(F.col("genres")), normalize_genre)
    return items.where(suggested != _known(F.col("genres"))).select(
        "item_id", "name", F.col("genres").alias("current_genres"), suggested.alias("suggested_genres")
    )


def variant_mapping_counts(items: DataFrame) -> DataFrame:
    """How often each variant maps to its canonical name."""
    return genre_counts(items).where("is_variant").select(F.col("genre").alias("variant"), "canonical", "n_items")


def variant_groups(items: DataFrame) -> DataFrame:
    """Variants found per canonical name, which the fixed spelling table bounds in lower case."""
    return variant_mapping_counts(items).groupBy("canonical").agg(
        F.countDistinct("variant").alias("n_variants"), F.sum("n_items").alias("n_items"),
        F.array_sort(F.collect_set(F.lower("variant"))).alias("variants"),
    )


def _similarity(a: Column, b: str) -> Column:
    """1 less the edit distance over the length of the longer name, by characters."""
    longest = F.greatest(F.length(a), F.lit(len(b)))
    return 1 - F.levenshtein(a, F.lit(b)) / longest


def suggest_mappings(items: DataFrame, least: float = 0.5, limit: int = 3) -> DataFrame:
    """Unknown genres with up to ``limit`` similar canonical names, the most similar first, by count.

    The comparison runs over the distinct genre names, not over items.
    """
    unknown = genre_counts(items).where(
        ~F.col("genre").isin(*K.CANONICAL_GENRES) & ~F.lower("genre").isin(*K.GENRE_ALIASES)
    )
    names = F.array(*[
        F.struct((-_similarity(F.col("genre"), name)).alias("neg"), F.lit(name).alias("name")) for name in K.CANONICAL_GENRES])
    close = F.slice(F.array_sort(F.filter(names, lambda n: n["neg"] <= -least)), 1, limit)
    suggestions = F.transform(close, lambda n: n["name"])
    return unknown.select("genre", "n_items", suggestions.alias("suggestions")).orderBy(F.desc("n_items"), "genre")


# ---------------------------------------------------------------------------- updates


def apply_genre_update(items: DataFrame, new_genres: Column, lock: bool = True) -> DataFrame:
    """Patch rows for the items whose set of genres changes: genres and lock fields."""
    own = _known(F.col("genres"))
    locked = F.coalesce("locked_fields", F.array().cast("array<string>"))
    new_locks = F.array_union(locked, F.array(F.lit("Genres"))) if lock else locked
    rows = items.withColumn("new_genres", new_genres)
    return rows.where(F.array_sort(own) != F.array_sort("new_genres")).select(
        "item_id", "name", own.alias("old_genres"), "new_genres",
        F.transform("new_genres", lambda g: F.struct(g.alias("name"))).alias("new_genre_items"),
        new_locks.alias("new_locked_fields"),
    )


def repair_duplicate_genres(items: DataFrame) -> DataFrame:
    """Items with their genre list freed of repeats, and whether it had any."""
    own = _known(F.col("genres"))
    return items.select("item_id", own.alias("genres"), F.array_distinct(own).alias("repaired"),
                        (F.array_distinct(own) != own).alias("had_duplicates"))


def normalize_genres_run(items: DataFrame) -> DataFrame:
    """All items with the status of a normalisation run and the genres after it.

    updated: the genre set changes; skipped: only repeats or order differ; clean: nothing to do.
    """
    new = normalize_genres(F.col("genres"))
    changed = F.array_sort(_known(F.col("genres"))) != F.array_sort(new)
    status = (
        F.when(~needs_normalizing(F.col("genres"), F.col("genre_items")), "clean")
        .when(changed, "updated").otherwise("skipped")
    )
    return items.withColumn("status", status).withColumn("new_genres", new)


def run_counters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n_items"))


# -------------------------------------------------------------------------- providers


def provider_fallback(items: DataFrame, snapshot: DataFrame, providers: Sequence[tuple[str, str]] = (("tmdb", "tmdb"), ("omdb", "imdb"))) -> DataFrame:
    """Adds ``external``: genres of the first provider that has any for the item, else empty.

    ``providers`` pairs a snapshot provider with the id it is asked by. Snapshot keys are
    unique, so each lookup is one equi join.
    """
    rows = items.withColumn(
        "_media", F.when(F.col("type") == "Series", F.lit("tv")).otherwise(F.lit("movie"))
    )
    found = []
    for name, id_kind in providers:
        table = snapshot.where(F.col("provider") == name).select(
            F.col("external_id").alias(f"_{name}_id"), F.col("media_type").alias(f"_{name}_media"),
            expand_compound_genres(F.col("genres")).alias(f"_{name}"),
        )
        rows = rows.withColumn("_id", provider_id(F.col("provider_ids"), id_kind))
        media = F.col(f"_{name}_media").isNull() | (F.col(f"_{name}_media") == F.col("_media"))
        rows = rows.join(table, (F.col("_id") == F.col(f"_{name}_id")) & media, "left").drop(
            "_id", f"_{name}_id", f"_{name}_media")
        found.append(F.when(F.size(f"_{name}") > 0, F.col(f"_{name}")))
    external = F.coalesce(*found, F.array().cast("array<string>"))
    return rows.withColumn("external", external).drop("_media", *[f"_{n}" for n, _ in providers])


def genre_requests(items: DataFrame, providers: Sequence[tuple[str, str]] = (("tmdb", "tmdb"), ("omdb", "imdb"))) -> DataFrame:
    """(item_id, place, provider, external_id, media_type, namespace, key): what a keyed store is asked for an item's genres."""
    media = F.when(F.col("type") == "Series", F.lit("tv")).otherwise(F.lit("movie"))
    asked = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(name).alias("provider"),
                               provider_id(F.col("provider_ids"), kind).alias("external_id")) for i, (name, kind) in enumerate(providers)])
    rows = items.select("item_id", media.alias("media_type"), F.explode(asked).alias("a")).select("item_id", "media_type", "a.*")
    key = store_key(F.col("provider"), F.col("external_id"), F.col("media_type"))
    return rows.withColumn("namespace", F.lit("genres")).withColumn("key", key).where("key IS NOT NULL")


def stored_snapshot(items: DataFrame, store: DataFrame, as_of: dt.datetime | str, ttl_seconds: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """The genre snapshot that ``provider_fallback`` and ``process_genres`` read, from fresh entries of a keyed store."""
    found = look_up(genre_requests(items).drop("item_id", "place").distinct(), store, as_of, ttl_seconds).where("status = 'fresh'")
    typed = F.when(F.col("provider") == "tmdb", F.col("media_type"))  # the other providers' ids name one title whatever its type
    return found.select("provider", "external_id", typed.alias("media_type"), F.col("value").alias("genres")).distinct()


def to_fetch(items: DataFrame, store: DataFrame, as_of: dt.datetime | str, ttl_seconds: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """(namespace, key) of lookups that a run needs and the store has not or no longer; fresh negative entries are not asked again."""
    asked = look_up(genre_requests(items).select("namespace", "key").distinct(), store, as_of, ttl_seconds)
    return asked.where(F.col("status").isin("missing", "stale")).select("namespace", "key")


def fix_genres(items: DataFrame, snapshot: DataFrame, mode: str = "gaps_only", ids: DataFrame | None = None,
               apply: bool = False) -> DataFrame:
    """Items of a run with their status and the additive merge.

    Ids pick their items; otherwise "gaps_only" takes items without genres, "validate" all.
    Status: no_data, no_diff, and dry_run or updated where genres would be added.
    """
    if ids is not None:
        rows = items.join(ids.select("item_id").distinct(), "item_id", "left_semi")
    elif mode == "gaps_only":
        rows = items.where(F.size(_known(F.col("genres"))) == 0)
    else:
        rows = items
    looked_up = provider_fallback(rows, snapshot).withColumn(
        "cmp", compare_genres(F.col("genres"), F.col("external")))
    status = (
        F.when(F.size("external") == 0, "no_data")
        .when(~F.col("cmp.has_diff"), "no_diff")
        .otherwise("updated" if apply else "dry_run")
    )
    merged = F.when(F.col("cmp.has_diff"), F.col("cmp.merged"))
    return looked_up.withColumn("status", status).withColumn("new_genres", merged).withColumn(
        "added", F.when(F.col("cmp.has_diff"), F.col("cmp.missing"))).drop("cmp")


def process_genres(items: DataFrame, snapshot: DataFrame, ids: DataFrame, apply: bool = True) -> DataFrame:
    """Normalise the picked items, then fix them on the normalised genres."""
    picked = items.join(ids.select("item_id").distinct(), "item_id", "left_semi")
    normalized = normalize_genres_run(picked)
    fresh = normalized.withColumn("was_normalized", F.col("status") == "updated").withColumn(
        "genres", F.when((F.col("status") == "updated") & F.lit(apply), F.col("new_genres")).otherwise(F.col("genres"))
    ).drop("status", "new_genres")
    return fix_genres(fresh, snapshot, "validate", apply=apply)

