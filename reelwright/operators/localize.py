"""Localised text: which items need it, which text to take, what to patch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright import constants as K
from reelwright.functions.util import blank, first_non_blank, lower_keys, non_blank, provider_id

# ------------------------------------------------------------------- language of texts


BUCKETS = 4096
SHARE = 1000


def _code(text: Column, place: int) -> Column:
    """Code point of a letter, 0 behind the end."""
    return F.ascii(F.substring(text, place, 1)).cast("bigint")


def _bucket(affix: Column) -> Column:
    return ((_code(affix, 1) * 961 + _code(affix, 2) * 31 + _code(affix, 3)) % BUCKETS).cast("int")


def affix_buckets(text: Column) -> Column:
    """Buckets of the first and the last three letters of each word, A-Z lower-cased; repeats kept."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(folded, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.array(_bucket(F.substring(w, 1, 3)), _bucket(F.right(w, F.lit(3))))))


def train_language_model(labelled: DataFrame, languages: Sequence[str], text: str = "text", label: str = "lang") -> DataFrame:
    """(language, weights): per language and bucket its share, in thousandths, of the bucket's relative counts.

    All labelled rows of the ``languages`` are counted, in whole numbers and with one added to each count; the counts
    are combined before the shuffle. The model has 4,096 numbers a language, whatever the size of the input.
    """
    known = labelled.where(F.col(label).isin(*languages)).select(F.col(label).alias("language"), F.explode(affix_buckets(F.col(text))).alias("bucket"))
    counts = known.groupBy("language", "bucket").agg(F.count("*").alias("n"))
    per_language = counts.groupBy("language").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("n"), F.sum("n").alias("total"))
    rate = F.expr(f"((coalesce(try_element_at(n, bucket), 0L) + 1) * 1000000000) div (total + {BUCKETS})")
    rates = per_language.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)))).select("language", "bucket", rate.alias("rate"))
    shares = rates.join(rates.groupBy("bucket").agg(F.sum("rate").alias("sum")), "bucket").select(
        "language", "bucket", F.expr(f"rate * {SHARE} div sum").alias("weight"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "weight")))
    return shares.groupBy("language").agg(F.transform(ordered, lambda s: s["weight"]).alias("weights"))


def detect_language(df: DataFrame, model: DataFrame, languages: Sequence[str], **texts: str) -> DataFrame:
    """Adds a column per name in ``texts``, with the language of the column it names.

    That is the language with the highest sum of weights, the least name on a tie; null for a text without words.
    The model is one small value on each row, so that scoring is a map over rows, without a shuffle.
    """
    names = sorted(languages)
    table = model.agg(F.map_from_entries(F.collect_list(F.struct("language", "weights"))).alias("weights")).scalar()
    given = df.withColumn("_model", table).withColumns({f"_buckets_{out}": affix_buckets(F.col(text)) for out, text in texts.items()})

    def total(buckets: Column, language: str) -> Column:
        weights = F.try_element_at("_model", F.lit(language))
        return F.aggregate(buckets, F.lit(0).cast("bigint"), lambda s, b: s + F.get(weights, b))

    def best(buckets: Column) -> Column:
        scored = F.array(*[F.struct((-total(buckets, name)).alias("score"), F.lit(name).alias("language")) for name in names])
        learned = F.filter(scored, lambda s: s["score"].isNotNull())
        return F.when(F.size(buckets) > 0, F.array_min(learned)["language"])

    found = given.withColumns({out: best(F.col(f"_buckets_{out}")) for out in texts})
    return found.drop("_model", *[f"_buckets_{out}" for out in texts])


def with_detected_languages(items: DataFrame, model: DataFrame, languages: Sequence[str]) -> DataFrame:
    """Items with ``overview_lang`` and ``tagline_lang`` as detected in their texts; null for a blank text."""
    return detect_language(items, model, languages, overview_lang="overview", tagline_lang="tagline")


# -------------------------------------------------------------------------- candidates


def localization_candidates(items: DataFrame, wanted: Sequence[str] = K.SLAVIC_LANGUAGES) -> DataFrame:
    """Items whose text is not yet in a ``wanted`` language, by the languages that ``with_detected_languages`` found.

    A blank text has no language and so counts as not localised.
    """
    def _localised(language: Column) -> Column:
        return F.coalesce(language.isin(*wanted), F.lit(False))

    episode = (
        non_blank(F.col("series_id")) & F.col("season").isNotNull() & F.col("episode").isNotNull()
        & ~_localised(F.col("overview_lang"))
    )
    title = non_blank(provider_id(F.col("provider_ids"), "tmdb")) & (
        (F.coalesce("production_year", F.lit(0)) == 0)
        | ~_localised(F.col("overview_lang")) | ~_localised(F.col("tagline_lang"))
    )
    return items.where(F.when(F.col("type") == "Episode", episode).otherwise(title))


def series_id_map(items: DataFrame) -> DataFrame:
    """(series_id, series_tmdb) of the series that have a tmdb id."""
    tmdb = F.try_element_at(lower_keys(F.col("provider_ids")), F.lit("tmdb"))
    return items.where(F.col("type") == "Series").select(
        F.col("item_id").alias("series_id"), tmdb.alias("series_tmdb")
    ).where(non_blank(F.col("series_tmdb")))


def with_snapshot_key(items: DataFrame, all_items: DataFrame) -> DataFrame:
    """Adds the key of the item's localised entry; episodes go by their series' id."""
    tmdb = F.nullif(provider_id(F.col("provider_ids"), "tmdb"), F.lit(""))
    kind = F.when(F.col("type") == "Series", "tv").when(F.col("type") == "BoxSet", "collection").otherwise("movie")
    episode_key = F.concat(F.lit("ep:"), F.col("series_tmdb"), F.lit(":s"), F.col("season").cast("string"),
                           F.lit("e"), F.col("episode").cast("string"))
    joined = items.join(series_id_map(all_items), "series_id", "left")
    key = F.when(F.col("type") == "Episode", episode_key).otherwise(F.concat(kind, F.lit(":"), tmdb))
    return joined.withColumn("key", key).drop("series_tmdb")


# --------------------------------------------------------------------------- payloads


def localized_payload(payload: Column, episode: bool = False) -> Column:
    """Provider payload as {title, overview, tagline, year}; episodes have the first two."""
    def clean(*names: str) -> Column:
        return F.trim(F.coalesce(first_non_blank(*[payload[n] for n in names]), F.lit("")))

    date = clean("release_date", "first_air_date")
    year = F.regexp_extract(date, r"^(\d{1,3}$|\d{4})", 1)
    title = clean("name") if episode else clean("title", "name")
    nothing = F.lit("")
    return F.struct(
        title.alias("title"), clean("overview").alias("overview"),
        (nothing if episode else clean("tagline")).alias("tagline"),
        (nothing if episode else year).alias("year"),
    )


def pick_by_language_chain(localized: Column, field: str, current: Column,
                           chain: Sequence[str] = K.LANGUAGE_CHAIN) -> Column:
    """struct(text, lang): first non-empty text of the chain; English too when there is none yet."""
    def entry(lang: str) -> Column:
        text = F.try_element_at(localized, F.lit(lang))[field]
        return F.when(non_blank(text), F.struct(text.alias("text"), F.lit(lang).alias("lang")))

    picks = [entry(lang) for lang in chain]
    if K.FALLBACK_LANGUAGE not in chain:
        empty = blank(F.trim(F.coalesce(current, F.lit(""))))
        picks.append(F.when(empty, entry(K.FALLBACK_LANGUAGE)))
    return F.coalesce(*picks)


def pick_year(localized: Column) -> Column:
    """First non-empty year of any language, languages in name order, as a number."""
    years = F.transform(F.array_sort(F.map_entries(localized)), lambda e: e["value"]["year"])
    return F.try_element_at(F.filter(years, non_blank), F.lit(1)).try_cast("int")


def pick_title(name: Column, title_lang: Column, localized: Column) -> Column:
    """English title for a title in a foreign language, when there is a different one."""
    english = F.try_element_at(localized, F.lit(K.FALLBACK_LANGUAGE))["title"]
    foreign = ~F.coalesce(title_lang.isin(*K.KEPT_TITLE_LANGUAGES), F.lit(False))
    differs = F.lower(F.trim(english)) != F.lower(F.trim(name))
    return F.when(non_blank(F.trim(name)) & foreign & non_blank(english) & differs, english)


# -------------------------------------------------------------------------- proposals


def propose_updates(items: DataFrame, all_items: DataFrame, snapshot: DataFrame,
                    chain: Sequence[str] = K.LANGUAGE_CHAIN, update_title: bool = True) -> DataFrame:
    """Candidates with the texts, title and year proposed for them.

    ``cache_hit`` says the snapshot knows the key, whatever its age; ``skipped`` that nothing
    came of it. The snapshot has one row per key, so the lookup is one equi join.
    """
    keyed = with_snapshot_key(localization_candidates(items), all_items)
    entries = snapshot.select("key", "localized", F.lit(True).alias("_known"))
    rows = keyed.join(entries, "key", "left")
    tagline = F.try_element_at("taglines", F.lit(1))
    no_year = F.coalesce("production_year", F.lit(0)) == 0
    title = pick_title(F.col("name"), F.col("title_lang"), F.col("localized")) if update_title else F.lit(None).cast("string")
    rows = rows.select(
        "*",
        pick_by_language_chain(F.col("localized"), "overview", F.col("overview"), chain).alias("_o"),
        pick_by_language_chain(F.col("localized"), "tagline", tagline, chain).alias("_t"),
        title.alias("new_title"),
        F.when(no_year, pick_year(F.col("localized"))).alias("new_year"),
        F.coalesce("_known", F.lit(False)).alias("cache_hit"),
    )
    nothing = F.col("_o").isNull() & F.col("_t").isNull() & F.col("new_title").isNull() & F.col("new_year").isNull()
    return rows.select(
        *keyed.columns, F.col("_o.text").alias("new_overview"), F.col("_o.lang").alias("overview_lang_used"),
        F.col("_t.text").alias("new_tagline"), F.col("_t.lang").alias("tagline_lang_used"),
        "new_title", "new_year", "cache_hit", nothing.alias("skipped"),
    )


def proposal_counters(proposed: DataFrame) -> DataFrame:
    """One row of counters of a proposal run."""
    found = {"found_overview": "new_overview", "found_tagline": "new_tagline",
             "found_title": "new_title", "found_year": "new_year"}
    return proposed.agg(
        *[F.count(F.col(c)).alias(n) for n, c in found.items()],
        F.count_if("skipped").alias("skipped_no_data"), F.count_if("cache_hit").alias("cache_hits"),
    )


def apply_metadata_patch(proposed: DataFrame, lock: bool = True) -> DataFrame:
    """Patch rows: per field the new value where it is unlocked and differs.

    A year only fills a gap and is never locked.
    """
    locked = F.coalesce("locked_fields", F.array().cast("array<string>"))
    tagline = F.try_element_at("taglines", F.lit(1))

    def change(new: str, current: Column, lock_name: str) -> Column:
        # An absent current value differs from any text except the empty one.
        return F.when(
            F.col(new).isNotNull() & ~F.array_contains(locked, lock_name)
            & (F.coalesce(current, F.lit("")) != F.col(new)), F.col(new))

    rows = proposed.select(
        "item_id", locked.alias("_locked"),
        change("new_overview", F.col("overview"), "Overview").alias("set_overview"),
        change("new_title", F.col("name"), "Name").alias("set_name"),
        F.when(F.col("new_tagline").isNotNull() & ~F.array_contains(locked, "Tagline")
               & ~tagline.eqNullSafe(F.col("new_tagline")), F.col("new_tagline")).alias("set_tagline"),
        F.when(F.coalesce("production_year", F.lit(0)) == 0, F.col("new_year")).alias("set_year"),
    )
    added = F.filter(F.array(*[
        F.when(F.col(c).isNotNull(), F.lit(n))
        for c, n in (("set_overview", "Overview"), ("set_name", "Name"), ("set_tagline", "Tagline"))
    ]), lambda x: x.isNotNull())
    locks = F.array_union("_locked", added) if lock else F.col("_locked")
    changed = F.coalesce("set_overview", "set_name", "set_tagline", F.col("set_year").cast("string")).isNotNull()
    return rows.where(changed).withColumn("new_locked_fields", locks).drop("_locked")
