"""Queries of the localisation family, of snapshots and of file sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelwright import schemas
from reelwright.operators import localize as L
from reelwright.session import checkpoint_dir
from reelwright.sources import sinks, snapshots
from verification.bridge import Bridge
from verification.registry import fragment, query

fragment("o_text", """SELECT t.*, CASE WHEN type = 'Episode' THEN coalesce(series_id <> '' AND season IS NOT NULL AND episode IS NOT NULL AND coalesce(overview_lang NOT IN ('cs', 'sk'), true), false)
ELSE tmdb IS NOT NULL AND (production_year IS NULL OR coalesce(overview_lang NOT IN ('cs', 'sk'), true) OR coalesce(tagline_lang NOT IN ('cs', 'sk'), true)) END AS candidate FROM b_text t""")
fragment("o_series_tmdb", "SELECT item_id AS series_id, tmdb AS series_tmdb FROM b_text WHERE type = 'Series' AND tmdb IS NOT NULL")
fragment("o_keyed", """SELECT t.*, CASE WHEN type = 'Episode' THEN 'ep:' || series_tmdb || ':s' || season || 'e' || episode WHEN type = 'Series' THEN 'tv:' || tmdb
WHEN type = 'BoxSet' THEN 'collection:' || tmdb ELSE 'movie:' || tmdb END AS key FROM o_text t LEFT JOIN o_series_tmdb USING (series_id) WHERE candidate""")
fragment("o_proposed", """SELECT *, new_overview IS NULL AND new_tagline IS NULL AND new_title IS NULL AND new_year IS NULL AS skipped FROM (SELECT k.*, l.key IS NOT NULL AS cache_hit,
CASE WHEN negative THEN NULL WHEN sk_overview <> '' THEN sk_overview WHEN cs_overview <> '' THEN cs_overview WHEN trim(overview) = '' AND en_overview <> '' THEN en_overview END AS new_overview,
CASE WHEN negative THEN NULL WHEN sk_overview <> '' THEN 'sk-SK' WHEN cs_overview <> '' THEN 'cs-CZ' WHEN trim(overview) = '' AND en_overview <> '' THEN 'en-US' END AS overview_lang_used,
CASE WHEN negative THEN NULL WHEN sk_tagline <> '' THEN sk_tagline WHEN cs_tagline <> '' THEN cs_tagline WHEN trim(coalesce(tagline, '')) = '' AND en_tagline <> '' THEN en_tagline END AS new_tagline,
CASE WHEN NOT negative AND coalesce(title_lang NOT IN ('cs', 'sk', 'en'), true) AND en_title <> '' AND lower(en_title) <> lower(name) THEN en_title END AS new_title,
CASE WHEN NOT negative AND production_year IS NULL THEN try_cast(year_text AS int) END AS new_year FROM o_keyed k LEFT JOIN b_localized l USING (key))""")


# the first and last three letters of every word, in 4,096 buckets, counted per language on the rows that are not held out
LEARNED = ("de", "en", "es", "fr")
_CODE = "((ascii({0}[1]) * 961 + CASE WHEN length({0}) > 1 THEN ascii({0}[2]) ELSE 0 END * 31 + CASE WHEN length({0}) > 2 THEN ascii({0}[3]) ELSE 0 END) % 4096)"
fragment("o_affixes", f"""SELECT doc_id, lang, {_CODE.format('a')} AS bucket, count(*) AS n FROM (SELECT doc_id, lang, unnest([left(w, 3), right(w, 3)]) AS a FROM
(SELECT doc_id, lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents)) GROUP BY ALL""")
fragment("o_rates", """SELECT l.lang, b.bucket, ((coalesce(n, 0) + 1) * 1000000000) // (total + 4096) AS rate FROM
(SELECT lang, sum(n)::bigint AS total FROM o_affixes WHERE doc_id % 4 <> 0 AND lang IN ('de', 'en', 'es', 'fr') GROUP BY 1) l CROSS JOIN (SELECT unnest(range(4096)) AS bucket) b
LEFT JOIN (SELECT lang, bucket, sum(n)::bigint AS n FROM o_affixes WHERE doc_id % 4 <> 0 GROUP BY ALL) c ON c.lang = l.lang AND c.bucket = b.bucket""")
fragment("o_shares", "SELECT lang, bucket, (rate * 1000) // (sum(rate) OVER (PARTITION BY bucket))::bigint AS weight FROM o_rates")
fragment("o_detected", """SELECT doc_id, arg_min(s.lang, (-score, s.lang)) AS detected FROM
(SELECT doc_id, s.lang, sum(n * weight)::bigint AS score FROM o_affixes a JOIN o_shares s USING (bucket) GROUP BY ALL) s GROUP BY 1""")


def _language_model(b: Bridge):
    return L.train_language_model(b.table("documents").where("doc_id % 4 <> 0"), LEARNED)


@query("language_weights", "SELECT lang AS language, bucket, weight FROM o_shares")
def _(b: Bridge):
    return _language_model(b).select("language", F.posexplode("weights").alias("bucket", "weight"))


@query("detect_language", "SELECT doc_id, lang, detected, doc_id % 4 = 0 AS held_out FROM documents LEFT JOIN o_detected USING (doc_id)")
def _(b: Bridge):
    docs = b.table("documents").select("doc_id", "text", "lang", (F.col("doc_id") % 4 == 0).alias("held_out"))
    return L.detect_language(docs, _language_model(b), LEARNED, detected="text").select("doc_id", "lang", "detected", "held_out")


@query("localization_detected", """SELECT doc_id, detected FROM documents LEFT JOIN o_detected USING (doc_id) WHERE CASE WHEN doc_id % 5 = 0 THEN coalesce(detected NOT IN ('de', 'fr'), true)
ELSE doc_id % 7 = 0 OR coalesce(detected NOT IN ('de', 'fr'), true) OR doc_id % 6 = 0 END""")
def _(b: Bridge):
    """Texts whose language is detected, then sought in German or French: one in five is an episode, one in six has no tagline."""
    tmdb = F.create_map(F.lit("Tmdb"), F.col("doc_id").cast("string"))
    items = b.table("documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, "Episode").otherwise("Movie").alias("type"), F.lit("s").alias("series_id"),
        F.lit(1).alias("season"), F.lit(1).alias("episode"), tmdb.alias("provider_ids"),
        F.when(F.col("doc_id") % 7 != 0, 2000).alias("production_year"), F.col("text").alias("overview"),
        F.when(F.col("doc_id") % 6 != 0, F.col("text")).alias("tagline"))
    found = L.with_detected_languages(items, _language_model(b), LEARNED)
    return L.localization_candidates(found, ("de", "fr")).select("doc_id", F.col("overview_lang").alias("detected"))


@query("localization_candidates", "SELECT item_id FROM o_text WHERE candidate")
def _(b: Bridge):
    return L.localization_candidates(b.text_items).select("item_id")


@query("series_id_map", "SELECT * FROM o_series_tmdb")
def _(b: Bridge):
    return L.series_id_map(b.text_items)


@query("localized_payload", """SELECT doc_id, 'T ' || source AS title, md5(trim(text)) AS overview, CASE WHEN doc_id % 3 = 0 THEN 'tag' ELSE '' END AS tagline,
CASE WHEN doc_id % 4 = 0 THEN (1990 + doc_id % 30)::varchar WHEN doc_id % 4 = 1 THEN (1980 + doc_id % 30)::varchar ELSE '' END AS year FROM documents""")
def _(b: Bridge):
    raw = F.struct(
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" T "), F.col("source"))).alias("title"),
        F.concat(F.lit("T "), F.col("source"), F.lit("  ")).alias("name"), F.col("text").alias("overview"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(" tag ")).alias("tagline"),
        F.when(F.col("doc_id") % 4 == 0, F.concat((1990 + F.col("doc_id") % 30).cast("string"), F.lit("-02-03")))
        .when(F.col("doc_id") % 4 == 2, F.lit("soon")).otherwise(F.lit("")).alias("release_date"),
        F.when(F.col("doc_id") % 4 == 1, F.concat((1980 + F.col("doc_id") % 30).cast("string"), F.lit("-01-01"))).alias("first_air_date"),
    )
    rows = b.table("documents").withColumn("p", L.localized_payload(raw))
    return rows.select("doc_id", "p.title", F.md5("p.overview").alias("overview"), "p.tagline", "p.year")


@query("pick_by_language_chain", """SELECT key, CASE WHEN negative THEN NULL WHEN cs_overview <> '' THEN cs_overview WHEN sk_overview <> '' THEN sk_overview
WHEN d % 3 = 1 AND en_overview <> '' THEN en_overview END AS text, CASE WHEN negative THEN NULL WHEN cs_overview <> '' THEN 'cs-CZ' WHEN sk_overview <> '' THEN 'sk-SK'
WHEN d % 3 = 1 AND en_overview <> '' THEN 'en-US' END AS lang FROM b_localized""")
def _(b: Bridge):
    number = F.regexp_extract("key", r"(\d+)", 1).cast("bigint") + F.when(F.col("key").startswith("ep:"), 2).otherwise(0)
    current = F.when(number % 3 == 1, F.lit("  ")).otherwise(F.lit("has text"))
    pick = L.pick_by_language_chain(F.col("localized"), "overview", current, ("cs-CZ", "sk-SK"))
    return b.localized.select("key", pick["text"].alias("text"), pick["lang"].alias("lang"))


@query("pick_year", "SELECT key, CASE WHEN NOT negative THEN try_cast(year_text AS int) END AS year FROM b_localized")
def _(b: Bridge):
    return b.localized.select("key", L.pick_year(F.col("localized")).alias("year"))


@query("pick_title", "SELECT item_id, new_title FROM o_proposed")
def _(b: Bridge):
    rows = L.with_snapshot_key(L.localization_candidates(b.text_items), b.text_items).join(b.localized.select("key", "localized"), "key", "left")
    return rows.select("item_id", L.pick_title(F.col("name"), F.col("title_lang"), F.col("localized")).alias("new_title"))


def _proposed(b: Bridge):
    return L.propose_updates(b.text_items, b.text_items, b.localized)


@query("propose_updates", "SELECT item_id, key, new_overview, overview_lang_used, new_tagline, new_title, new_year, cache_hit, skipped FROM o_proposed")
def _(b: Bridge):
    return _proposed(b).select("item_id", "key", "new_overview", "overview_lang_used", "new_tagline", "new_title", "new_year", "cache_hit", "skipped")


@query("propose_updates_counters", """SELECT count(new_overview) AS found_overview, count(new_tagline) AS found_tagline, count(new_title) AS found_title,
count(new_year) AS found_year, count(*) FILTER (skipped) AS skipped_no_data, count(*) FILTER (cache_hit) AS cache_hits FROM o_proposed""")
def _(b: Bridge):
    return L.proposal_counters(_proposed(b))


@query("apply_metadata_patch", """SELECT item_id, so AS set_overview, sn AS set_name, st AS set_tagline, new_year AS set_year, array_to_string(list_filter([
CASE WHEN locks_overview OR so IS NOT NULL THEN 'Overview' END, CASE WHEN locks_name OR sn IS NOT NULL THEN 'Name' END,
CASE WHEN locks_tagline OR st IS NOT NULL THEN 'Tagline' END], lambda v: v IS NOT NULL), '|') AS locks FROM (SELECT *,
CASE WHEN NOT locks_overview AND new_overview <> coalesce(overview, '') THEN new_overview END AS so, CASE WHEN NOT locks_name AND new_title <> name THEN new_title END AS sn,
CASE WHEN NOT locks_tagline AND new_tagline IS DISTINCT FROM tagline THEN new_tagline END AS st FROM o_proposed) WHERE so IS NOT NULL OR sn IS NOT NULL OR st IS NOT NULL OR new_year IS NOT NULL""")
def _(b: Bridge):
    order = F.create_map(*[F.lit(x) for x in ("Overview", 1, "Name", 2, "Tagline", 3)])
    ranked = F.array_sort(F.transform("new_locked_fields", lambda x: F.struct(F.try_element_at(order, x).alias("o"), x.alias("n"))))
    return L.apply_metadata_patch(_proposed(b)).select(
        "item_id", "set_overview", "set_name", "set_tagline", "set_year",
        F.array_join(F.transform(ranked, lambda r: r["n"]), "|").alias("locks"))


# -------------------------------------------------------------------------- snapshots
@query("snapshot_freshness", """SELECT r.key, CASE WHEN l.key IS NULL THEN 'missing' WHEN age_days >= 30 THEN 'stale' WHEN negative THEN 'negative' ELSE 'fresh' END AS status FROM
(SELECT key FROM o_keyed WHERE key IS NOT NULL UNION SELECT 'movie:x' || doc_id FROM documents) r LEFT JOIN b_localized l USING (key)""")
def _(b: Bridge):
    wanted = L.with_snapshot_key(L.localization_candidates(b.text_items), b.text_items).where("key IS NOT NULL").select("key")
    strangers = b.table("documents").select(F.concat(F.lit("movie:x"), F.col("doc_id").cast("string")).alias("key"))
    return snapshots.snapshot_freshness(wanted.unionByName(strangers), b.localized, "2024-12-31 00:00:00", "localized")


@query("sink_snapshot", """SELECT key, CASE WHEN d % 5 = 0 THEN NULL ELSE CASE WHEN NOT negative THEN en_title END END AS en_title, CASE WHEN d % 5 = 0 THEN 0 ELSE age_days END AS age_days FROM b_localized""")
def _(b: Bridge):
    fetched = b.localized.where(F.col("key").startswith("tv:")).withColumn("localized", F.lit(None).cast(b.localized.schema["localized"].dataType)).withColumn(
        "fetched_at", F.lit("2024-12-31 00:00:00").cast("timestamp"))
    path = f"{checkpoint_dir(b.spark)}/snapshot-{uuid.uuid4().hex}"
    snapshots.write_snapshot(snapshots.merge_snapshot(b.localized, fetched), path)
    back = snapshots.read_snapshot(b.spark, path, schemas.LOCALIZED_SNAPSHOT)
    return back.select("key", F.try_element_at("localized", F.lit("en-US"))["title"].alias("en_title"),
                       F.datediff(F.lit("2024-12-31").cast("date"), "fetched_at").alias("age_days"))


@query("sink_json_report", """SELECT item_id, name, production_year AS year, library, coalesce(size, 0) AS size_bytes, round_even(cast(age AS decimal(38, 12)), 2)::double AS age_years FROM o_movies WHERE stage = 'candidate'""")
def _(b: Bridge):
    from verification.retention import _movies

    rows = sinks.cleanup_report(_movies(b).where("stage = 'candidate'"))
    path = f"{checkpoint_dir(b.spark)}/report-{uuid.uuid4().hex}"
    sinks.write_json_report(sinks.report_header(rows, "size_bytes"), rows, path)
    schema = "item_id string, name string, year int, library string, size_bytes bigint, age_years double"
    return b.spark.read.schema(schema).json(f"{path}/rows")
