"""Queries of the duplicate family: index, components, selection, guard, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwright.functions import display, quality
from reelwright.functions import paths as P
from reelwright.functions.dates import age_years  # noqa: F401  (re-exported for tests)
from reelwright.functions.streams import first_stream
from reelwright.operators import components, guard, index, reports, select
from reelwright.plans import dedupe
from reelwright.plans.dedupe import DedupeParams
from reelwright.session import cut_lineage, shared_folder
from reelwright.sources import sinks
from verification.bridge import Bridge
from verification.registry import fragment, query

PRIORITIES = ("slovak", "cze", "eng")
EXCLUDED = ("tt0000040", "TT0000123", "20112", "40", "2531", "4032")
PARAMS = DedupeParams(PRIORITIES, EXCLUDED)
_EXCL_SQL = "('tt0000040', 'TT0000123', '20112', '40', '2531', '4032')"

# ------------------------------------------------------------------------- shared SQL
fragment("o_provider_index", """
SELECT 'imdb' AS provider, imdb AS pid, item_id, library, is_ep AS is_episode, series_name, season, episode
FROM b_items WHERE imdb <> 'tt0000000'
UNION ALL SELECT 'tmdb', tmdb, item_id, library, is_ep, series_name, season, episode FROM b_items WHERE tmdb IS NOT NULL
UNION ALL SELECT 'tvdb', tvdb, item_id, library, is_ep, series_name, season, episode FROM b_items WHERE tvdb IS NOT NULL""")
fragment("o_episode_index", """
SELECT DISTINCT 'series_episode' AS provider, series_name || '|S' || season || 'E' || episode AS pid, item_id, library,
is_ep AS is_episode, series_name, season, episode FROM b_items WHERE is_ep""")
fragment("o_entries", "SELECT * FROM o_provider_index UNION ALL SELECT * FROM o_episode_index")
fragment("o_links", f"""
SELECT provider, item_id, CASE WHEN is_episode AND season IS NOT NULL AND episode IS NOT NULL
THEN 'ep|' || pid || '|' || series_name || '|S' || season || 'E' || episode ELSE 'id|' || pid END AS link
FROM o_entries WHERE pid NOT IN {_EXCL_SQL}""")
fragment("o_edges", """
SELECT DISTINCT item_id AS src, dst FROM
(SELECT *, min(item_id) OVER (PARTITION BY provider, link) AS dst FROM o_links) WHERE item_id <> dst""")
fragment("o_components", """
WITH RECURSIVE pairs AS (SELECT src AS a, dst AS b FROM o_edges UNION SELECT dst, src FROM o_edges),
reach AS (SELECT a AS item_id, a AS other FROM pairs
UNION SELECT reach.item_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other)
SELECT item_id, min(other) AS component FROM reach GROUP BY item_id""")
fragment("o_groups", """
SELECT min(item_id) OVER (PARTITION BY component, part) AS group_id, item_id FROM
(SELECT *, count(*) OVER (PARTITION BY component, part) AS n FROM
(SELECT o_components.item_id, component, CASE WHEN bool_or(is_ep) OVER (PARTITION BY component)
THEN CASE WHEN is_ep THEN series_name || '|S' || season || 'E' || episode ELSE 'NON_SERIES' END ELSE '' END AS part
FROM o_components JOIN b_items USING (item_id))) WHERE n > 1""")
fragment("o_group_members", "SELECT o_groups.group_id, b_items.* FROM o_groups JOIN b_items USING (item_id)")
fragment("o_exclusion_hits", """
SELECT group_id, min(item_id) AS item_id, arg_min(excluded_id, item_id) AS excluded_id FROM
(SELECT group_id, item_id, CASE WHEN lower(imdb) IN ('tt0000040', 'tt0000123') THEN lower(imdb)
WHEN tmdb IN ('20112', '40', '2531', '4032') THEN tmdb WHEN tvdb IN ('20112', '40', '2531', '4032') THEN tvdb END AS excluded_id
FROM o_group_members) WHERE excluded_id IS NOT NULL GROUP BY group_id""")
fragment("o_allowed", "SELECT * FROM o_group_members WHERE group_id NOT IN (SELECT group_id FROM o_exclusion_hits)")


def _filename_part(part: int) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(file, '{p}') THEN regexp_extract(file, '{p}', {part + shift})"
        for p, shift in (
            (r"[Ss](\d+)[Ee](\d+)", 0), (r"(\d+)[xX](\d+)", 0), (r"[sS](\d+)\.?[eE](\d+)", 0),
            (r"[sS](\d+)_[eE](\d+)", 0), (r"(^|[^0-9])([1-9])(\d{2})($|[^0-9])", 1),
        )
    )
    return f"regexp_replace(CASE {arms} END, '^0+(.)', '\\1')"


fragment("o_file_key", f"""
SELECT *, {_filename_part(1)} AS fs, {_filename_part(2)} AS fe FROM o_allowed""")
fragment("o_path_keyed", """
SELECT *, CASE WHEN is_ep AND fs IS NOT NULL THEN series_name || '|S' || fs || 'E' || fe END AS fkey FROM o_file_key""")
fragment("o_path_filtered", """
SELECT o_path_keyed.* FROM o_path_keyed LEFT JOIN
(SELECT group_id, fkey AS best FROM (SELECT group_id, fkey, count(*) AS n FROM o_path_keyed WHERE fkey IS NOT NULL GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, fkey) = 1) USING (group_id)
WHERE fkey IS NULL OR fkey = best""")
fragment("o_members", """
SELECT * FROM (SELECT * FROM o_path_filtered QUALIFY row_number() OVER (PARTITION BY group_id, path ORDER BY item_id) = 1)
QUALIFY count(*) OVER (PARTITION BY group_id) > 1""")


def _tier_case(text: str, values: tuple[str, str, str, str, str]) -> str:
    return (
        f"CASE WHEN regexp_matches(upper({text}), 'REMUX|BD\\.REMUX') THEN {values[0]} "
        f"WHEN regexp_matches(upper({text}), 'BLURAY|BLU-RAY|BRRIP|BDRIP|BD\\.RIP') THEN {values[1]} "
        f"WHEN regexp_matches(upper({text}), 'WEB-DL|WEBDL|WEB\\.DL|WEBRIP|WEB-RIP|WEB\\.RIP') THEN {values[2]} "
        f"WHEN regexp_matches(upper({text}), 'HDTV|DVB|PDTV') THEN {values[3]} ELSE {values[4]} END"
    )


TIER_MULT = ("1.3e0", "1.15e0", "1.0e0", "0.9e0", "0.95e0")
TIER_NAME = ("'bluray_remux'", "'bluray'", "'webdl'", "'hdtv'", "'unknown'")
AI_SQL = "regexp_matches(upper({0}), 'AI[._-]UPSCALE|UPSCALED|AI[._-]ENHANCED')"

fragment("o_factors", f"""
SELECT *, width * height / 1e6 AS mp, coalesce(vbitrate, 0) / 1e6 AS mbps,
CASE WHEN lower(replace(coalesce(video_range, ''), ' ', '')) NOT IN ('', 'sdr', 'unknown', 'none') OR
regexp_matches(lower(file || '|' || name), '(^|[^a-z0-9])(hdr10\\+?|hdr|dolby[ ._-]?vision|dovi|hlg)($|[^a-z0-9])') THEN 1.0e0 ELSE 0.0e0 END AS hdr_f,
CASE WHEN height >= 2000 THEN 6.0e0 WHEN height >= 1000 THEN 2.5e0 WHEN height >= 700 THEN 1.2e0 ELSE 0.0e0 END AS flo,
CASE vcodec WHEN 'hevc' THEN 0.65e0 ELSE 1.0e0 END AS eff, coalesce(size, 0) AS sz,
runtime_ticks / 600000000.0e0 AS minutes,
{_tier_case('path', TIER_MULT)} AS src_m, CASE WHEN {AI_SQL.format('path')} THEN 0.7e0 ELSE 1.0e0 END AS ai_m,
CASE WHEN starts_with(coalesce(dv_subtype, ''), 'DoviProfile5') THEN 0.0001e0 ELSE 1.0e0 END AS p5_m,
coalesce(epoch(try_cast(date_created AS timestamp)), 0) AS epoch_s FROM b_items""")
fragment("o_scored", """
SELECT *, (credit + hdr_part + mbps + audio_part + date_part) * src_m * ai_m * p5_m AS total FROM
(SELECT *, CASE WHEN starved THEN mp * (adequacy / (flo * eff)) ELSE mp END * 10.0e0 AS credit, hdr_f * 5.0e0 AS hdr_part,
channels * 0.5e0 AS audio_part, epoch_s / 1e9 * 0.01e0 AS date_part FROM
(SELECT *, adequacy > 0 AND flo > 0 AND adequacy < flo * eff AS starved FROM
(SELECT *, CASE WHEN mbps > 0 THEN mbps WHEN sz > 0 AND minutes > 0 THEN (sz * 0.9e0 * 8.0e0) / (minutes * 60.0e0) / 1e6 ELSE 0.0e0 END AS adequacy
FROM o_factors)))""")
fragment("o_rated", """
SELECT m.group_id, o_scored.*, CASE lang1 WHEN 'slo' THEN 0 WHEN 'cze' THEN 1 WHEN 'eng' THEN 2 ELSE 9999 END AS lang_rank,
CASE lang1 WHEN 'slo' THEN 'sk' WHEN 'cze' THEN 'cs' WHEN 'eng' THEN 'eng' END AS priority_language,
(lang1 IS NOT NULL)::int + (lang2 IS NOT NULL)::int AS n_languages
FROM (SELECT group_id, item_id FROM o_members) m JOIN o_scored USING (item_id)""")
fragment("o_choice", """
SELECT q.group_id, q.item_id AS best_quality_id, l.item_id AS best_language_id, coalesce(l.item_id IS NOT NULL AND q.item_id <> l.item_id AND
((l.n_languages = 1 AND q.n_languages >= 2 AND ratio > 2.5) OR (q.lang_rank = 9999 AND ratio > 5) OR (q.lang_rank < 9999 AND ratio > 4)), false) AS override,
q.priority_language AS q_lang, l.priority_language AS l_lang FROM
(SELECT * FROM o_rated QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY total DESC, item_id) = 1) q LEFT JOIN
(SELECT * FROM o_rated WHERE lang_rank < 9999 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY lang_rank, total DESC, item_id) = 1) l USING (group_id),
LATERAL (SELECT CASE WHEN l.total > 0 THEN q.total / l.total ELSE 'inf'::double END AS ratio)""")
fragment("o_kept", """
SELECT *, CASE WHEN best_language_id IS NOT NULL AND NOT override THEN best_language_id ELSE best_quality_id END AS keep_id,
CASE WHEN best_language_id IS NOT NULL AND NOT override THEN l_lang ELSE q_lang END AS used_lang FROM o_choice""")
fragment("o_decisions", """
SELECT o_rated.*, keep_id, CASE WHEN item_id = keep_id THEN 'keep' ELSE 'delete' END AS role, used_lang IS NOT NULL AS selected_by_language,
used_lang IS NOT NULL AND keep_id <> best_quality_id AS changed_by_language, used_lang AS priority_language_used
FROM o_rated JOIN o_kept USING (group_id)""")
fragment("o_pairs", """
SELECT d.*, k.path AS keep_path, k.folder AS keep_folder, k.runtime_ticks AS keep_ticks, k.file AS keep_file FROM o_decisions d
JOIN b_items k ON k.item_id = d.keep_id WHERE role = 'delete'""")
fragment("o_survivors", """
SELECT DISTINCT folder, path FROM b_items WHERE path NOT IN (SELECT path FROM o_decisions WHERE role = 'delete')""")
fragment("o_guarded", """
SELECT *, CASE WHEN NOT starts_with(keep_path, folder || '/') THEN 'other folder'
WHEN starts_with(regexp_replace(file, '\\.[^.]*$', ''), regexp_extract(folder, '[^/]*$')) THEN 'title folder'
WHEN (SELECT count(*) FROM o_survivors s WHERE s.folder = p.folder AND s.path <> p.path AND s.path <> p.keep_path) > 0 THEN 'shared folder'
ELSE 'dedicated folder' END AS verdict FROM o_pairs p""")
fragment("o_added", """
SELECT *, coalesce(strftime(try_cast(date_created AS timestamp), '%Y-%m-%d %H:%M'), date_created,
strftime(try_cast(date_modified AS timestamp), '%Y-%m-%d %H:%M'), strftime(try_cast(premiere_date AS timestamp), '%Y-%m-%d'),
production_year || '-01-01 (year only)', 'unknown') AS date_added FROM o_decisions""")


# ------------------------------------------------------------------------------ index
@query("provider_index", "SELECT provider, pid, item_id, library, is_episode FROM o_provider_index")
def _(b: Bridge):
    return index.provider_index(b.items).select("provider", "pid", "item_id", "library", "is_episode")


@query("series_episode_index", "SELECT pid, item_id, library FROM o_episode_index")
def _(b: Bridge):
    return index.series_episode_index(b.items).select("pid", "item_id", "library")


@query("merge_indexes", "SELECT provider, library, count(*) AS n_entries, count(DISTINCT pid) AS n_ids FROM o_entries GROUP BY ALL")
def _(b: Bridge):
    return dedupe.full_index(b.items).groupBy("provider", "library").agg(
        F.count("*").alias("n_entries"), F.countDistinct("pid").alias("n_ids"))


@query("identify_duplicates", f"""SELECT provider, pid, count(DISTINCT item_id) AS n_items FROM o_entries
WHERE pid NOT IN {_EXCL_SQL} GROUP BY ALL HAVING count(DISTINCT item_id) > 1""")
def _(b: Bridge):
    return index.identify_duplicates(dedupe.full_index(b.items), EXCLUDED)


@query("duplicate_edges", "SELECT src, dst FROM o_edges")
def _(b: Bridge):
    return index.duplicate_edges(dedupe.full_index(b.items), EXCLUDED)


@query("connected_components", "SELECT item_id, component FROM o_components")
def _(b: Bridge):
    return components.connected_components(index.duplicate_edges(dedupe.full_index(b.items), EXCLUDED))


@query("verify_groups", "SELECT group_id, item_id FROM o_groups")
def _(b: Bridge):
    return dedupe.duplicate_groups(b.items, PARAMS)


@query("collect_item_metadata", """SELECT item_id, arg_max(provider, pid_key) AS provider, max(library) AS library,
bool_or(is_episode) AS is_episode FROM (SELECT *, provider || ' ' || pid AS pid_key FROM o_entries) GROUP BY item_id""")
def _(b: Bridge):
    return index.item_metadata(dedupe.full_index(b.items)).select("item_id", "provider", "library", "is_episode")


def _members(b: Bridge):
    return dedupe.duplicate_groups(b.items, PARAMS).join(b.items, "item_id")


@query("group_exclusion", "SELECT group_id, item_id FROM o_allowed")
def _(b: Bridge):
    return select.group_exclusion(_members(b), EXCLUDED).select("group_id", "item_id")


@query("excluded_groups", """SELECT h.group_id, h.item_id, h.excluded_id, CASE WHEN m.is_ep THEN m.series_name || ' - ' || m.name ELSE m.name END AS title,
m.path, coalesce(m.size, 0) AS size, m.production_year AS year, concat_ws(',', m.lang1, m.lang2) AS languages
FROM o_exclusion_hits h JOIN o_group_members m ON m.group_id = h.group_id AND m.item_id = h.item_id""")
def _(b: Bridge):
    return select.excluded_report(_members(b), EXCLUDED).select(
        "group_id", "item_id", "excluded_id", "title", "path", "size", "year", "languages")


@query("episode_key_from_filename", f"""SELECT item_id, {_filename_part(1)} AS season_text, {_filename_part(2)} AS episode_text FROM b_items""")
def _(b: Bridge):
    key = P.episode_key_from_filename(F.col("path"))
    return b.items.select("item_id", key["season"].alias("season_text"), key["episode"].alias("episode_text"))


@query("episode_path_filter", "SELECT group_id, item_id FROM o_path_filtered")
def _(b: Bridge):
    members = cut_lineage(select.group_exclusion(_members(b), EXCLUDED).select("group_id", *dedupe.CHECK_COLUMNS))
    return select.episode_path_filter(members).select("group_id", "item_id")


@query("dedupe_by_path", "SELECT group_id, item_id, path FROM o_members")
def _(b: Bridge):
    return dedupe.candidates(b.items, PARAMS).join(b.items.select("item_id", "path"), "item_id")


# ----------------------------------------------------------------------------- rating
@query("rate_items", """SELECT item_id, total AS rating, credit, starved, hdr_part AS hdr,
mbps AS bitrate, audio_part AS audio, src_m AS source, ai_m AS ai, p5_m AS dovi_p5 FROM o_scored""")
def _(b: Bridge):
    s = F.col("score")
    return select.rate_items(b.items).select(
        "item_id", F.col("rating").alias("rating"), s["resolution_credit"].alias("credit"),
        s["starved"].alias("starved"), s["hdr"].alias("hdr"), s["bitrate"].alias("bitrate"),
        s["audio"].alias("audio"), s["source_multiplier"].alias("source"), s["ai_multiplier"].alias("ai"),
        s["dovi_p5_multiplier"].alias("dovi_p5"))


@query("language_scores", """SELECT group_id, item_id, lang_rank, priority_language, n_languages FROM o_rated""")
def _(b: Bridge):
    ranked = dedupe.rated_members(b.items, PARAMS)
    return ranked.select("group_id", "item_id", "lang_rank", "priority_language", F.size("languages").alias("n_languages"))


@query("smart_override", """SELECT group_id, best_quality_id, best_language_id, override, keep_id FROM o_kept""")
def _(b: Bridge):
    return select.smart_override(dedupe.rated_members(b.items, PARAMS)).select(
        "group_id", "best_quality_id", "best_language_id", "override", "keep_id")


@query("select_keep_delete", """SELECT group_id, item_id, role, total AS rating, selected_by_language, changed_by_language,
priority_language_used FROM o_decisions""")
def _(b: Bridge):
    return dedupe.decide(b.items, PARAMS).select(
        "group_id", "item_id", "role", F.col("rating").alias("rating"), "selected_by_language",
        "changed_by_language", "priority_language_used")


@query("enrich_decision", """SELECT d.group_id, d.item_id, d.role, d.is_ep AS is_episode, d.season, d.episode,
coalesce(d.imdb, d.tmdb, d.tvdb) AS provider_id, k.name AS group_name FROM o_decisions d JOIN b_items k ON k.item_id = d.keep_id""")
def _(b: Bridge):
    return select.enrich_decision(dedupe.decide(b.items, PARAMS)).select(
        "group_id", "item_id", "role", "is_episode", "season", "episode", "provider_id", "group_name")


_POSTERS = "https://image.example.org/w300/"


@query("poster_fallback", f"""SELECT item_id, CASE WHEN k % 8 = 1 THEN 'img/' || item_id
WHEN regexp_full_match(coalesce(imdb, tmdb, tvdb), '[0-9]+') THEN '{_POSTERS}' || coalesce(imdb, tmdb, tvdb) || '.jpg'
WHEN tmdb IS NOT NULL THEN '{_POSTERS}' || tmdb || '.jpg' ELSE '' END AS image FROM b_items""")
def _(b: Bridge):
    entries = b.items.withColumn("ids", select.lower_keys(F.col("provider_ids")))
    primary = F.coalesce(F.col("ids")["imdb"], F.col("ids")["tmdb"], F.col("ids")["tvdb"])
    own = F.when(F.col("k") % 8 == 1, F.concat(F.lit("img/"), F.col("item_id")))
    return entries.select("item_id", select.poster_fallback(own, primary, F.col("ids")["tmdb"], _POSTERS).alias("image"))


# ------------------------------------------------------------------------------ guard
@query("known_and_delete_paths", """SELECT count(*) AS n_known, (SELECT count(DISTINCT path) FROM o_decisions WHERE role = 'delete') AS n_deleted,
(SELECT count(DISTINCT path) FROM o_decisions) AS n_decided FROM (SELECT DISTINCT path FROM b_items)""")
def _(b: Bridge):
    d = dedupe.decide(b.items, PARAMS).select("path", "role")
    tagged = (
        guard.known_paths(d, b.items).withColumn("kind", F.lit("known"))
        .unionByName(guard.delete_paths(d).withColumn("kind", F.lit("deleted")))
        .unionByName(guard.known_paths(d).withColumn("kind", F.lit("decided")))
    )
    return tagged.agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("known", "deleted", "decided")])


@query("delete_safe", "SELECT group_id, item_id, verdict, verdict IN ('other folder', 'shared folder') AS safe FROM o_guarded")
def _(b: Bridge):
    rows = dedupe.guarded_decisions(b.items, PARAMS, ()).where("role = 'delete'")
    return rows.select("group_id", "item_id", "verdict", "safe")


@query("guard_pass", """SELECT status, verdict, count(*) AS n_items FROM (SELECT *, CASE WHEN verdict IN ('other folder', 'shared folder')
THEN 'not_attempted' ELSE 'skipped_unsafe' END AS status FROM o_guarded) GROUP BY ALL""")
def _(b: Bridge):
    rows = dedupe.guarded_decisions(b.items, PARAMS, ()).where("role = 'delete'")
    return rows.groupBy("status", "verdict").agg(F.count("*").alias("n_items"))


# every item created in the odd months leaves the library in this clean-up
fragment("o_clean_targets", "SELECT * FROM b_items WHERE k % 3 = 1")
fragment("o_clean_survivors", """SELECT DISTINCT folder, path FROM b_items WHERE path NOT IN (SELECT path FROM o_clean_targets)""")
fragment("o_clean_below", """SELECT dir, count(*) AS n FROM (SELECT unnest(list_transform(range(2, len(string_split(folder, '/')) + 1),
lambda n: array_to_string(string_split(folder, '/')[1:n], '/'))) AS dir FROM o_clean_survivors) GROUP BY dir""")


@query("cleanup_delete_safe", """SELECT item_id, CASE WHEN coalesce(bel.n, 0) = 0 THEN 'nothing stays'
WHEN starts_with(regexp_replace(file, '\\.[^.]*$', ''), regexp_extract(folder, '[^/]*$')) THEN 'title folder'
WHEN coalesce(dct.n, 0) >= 2 THEN 'shared folder' ELSE 'dedicated folder' END AS reason FROM o_clean_targets t
LEFT JOIN o_clean_below bel ON bel.dir = t.folder LEFT JOIN
(SELECT folder AS dir, count(*) AS n FROM o_clean_survivors GROUP BY 1) dct ON dct.dir = t.folder""")
def _(b: Bridge):
    targets = b.items.where("k % 3 = 1").select("item_id", "path", F.col("path").alias("delete_path"))
    known = b.items.select("path").distinct()
    return guard.cleanup_delete_safe(targets, known, targets.select("path")).select("item_id", "reason")


@query("fold_safe_plan", """SELECT group_id, item_id, CASE WHEN duration IS NULL AND n <= 5 THEN 'ok' ELSE 'needs_review' END AS status,
concat_ws('; ', duration, CASE WHEN n > 5 THEN 'group too large (' || n || ' planned deletes)' END) AS review_reason FROM
(SELECT *, count(*) OVER (PARTITION BY group_id) AS n, CASE WHEN keep_ticks IS NULL OR runtime_ticks IS NULL THEN 'duration unknown'
WHEN abs(ks - ds) > greatest(0.02e0 * greatest(ks, ds), 15.0e0) THEN 'duration mismatch (keeper ' || ks::bigint || 's, delete ' || ds::bigint || 's)' END AS duration
FROM (SELECT *, keep_ticks / 1e7 AS ks, runtime_ticks / 1e7 AS ds FROM o_guarded)
WHERE verdict IN ('title folder', 'dedicated folder') AND keep_path <> path)""")
def _(b: Bridge):
    rows = dedupe.guarded_decisions(b.items, PARAMS, ()).where("role = 'delete'")
    return guard.fold_safe_plan(rows).select("group_id", "item_id", "status", "review_reason")


_OWNED = """SELECT item_id, path, folder, regexp_replace(file, '\\.[^.]*$', '') AS stem, is_ep, ep_text,
starts_with(regexp_replace(file, '\\.[^.]*$', ''), regexp_extract(folder, '[^/]*$')) OR
(SELECT count(DISTINCT x.path) FROM b_items x WHERE x.folder = i.folder) = 1 AS owned FROM b_items i"""
fragment("o_owned", _OWNED)


@query("owned_folder", "SELECT item_id, owned FROM o_owned")
def _(b: Bridge):
    files = b.items.select("path").distinct()
    return b.items.select("item_id", "path").join(guard.owned_folder(files), "path").select("item_id", "owned")


@query("safe_output_path", """SELECT item_id, CASE WHEN NOT owned THEN folder || '/' || stem || ' [HDR10].mkv'
WHEN regexp_matches(stem, '(?i)s\\d{1,2}\\s*e\\d{1,3}') THEN CASE WHEN regexp_matches(folder, '/Season \\d+/')
THEN regexp_extract(folder, '^(.*/Season \\d+)/', 1) ELSE regexp_extract(folder, '^(.*)/[^/]*$', 1) END || '/' || stem || ' [HDR10].mkv'
ELSE regexp_extract(folder, '^(.*)/[^/]*$', 1) || '/' || stem || ' [HDR10]/' || stem || ' [HDR10].mkv' END AS output_path FROM o_owned""")
def _(b: Bridge):
    files = guard.safe_output_path(guard.owned_folder(b.items.select("path").distinct()))
    return b.items.select("item_id", "path").join(files, "path").select("item_id", "output_path")


@query("path_functions", """SELECT item_id, folder AS parent_dir, file AS basename, regexp_replace(file, '\\.[^.]*$', '') AS stem,
starts_with(regexp_replace(file, '\\.[^.]*$', ''), regexp_extract(folder, '[^/]*$')) AS per_title FROM b_items""")
def _(b: Bridge):
    path = P.path_norm(F.translate(F.concat(F.col("path"), F.lit("/")), "/", "\\"))
    return b.items.select(
        "item_id", P.parent_dir(path).alias("parent_dir"), P.basename(path).alias("basename"),
        P.path_stem(path).alias("stem"), P.is_per_title(path).alias("per_title"))


# ---------------------------------------------------------------------------- reports
_STATUS = """CASE WHEN role = 'delete' THEN CASE WHEN k % 4 = 0 THEN 'success' WHEN k % 4 = 1 THEN 'failed' ELSE 'skipped_unsafe' END END"""
fragment("o_reported", f"SELECT *, {_STATUS} AS status FROM o_added")


def _reported(b: Bridge, columns: tuple[str, ...] | None = None):
    """Enriched decisions with a status; ``columns`` names what is read besides the keepers' columns, all if not given."""
    named = None if columns is None else (*select.KEEPER_COLUMNS, *columns)
    status = (F.when(F.col("k") % 4 == 0, "success").when(F.col("k") % 4 == 1, "failed").otherwise("skipped_unsafe"))
    return select.enrich_decision(dedupe.decide(b.items, PARAMS, named)).withColumn("k", F.col("item_id").cast("bigint")).withColumn(
        "status", F.when(F.col("role") == "delete", status))


@query("dedupe_stats", """SELECT count(*) FILTER (role = 'keep') AS total_groups, count(*) FILTER (role = 'delete') AS items_to_delete,
count(*) FILTER (status = 'success') AS deleted, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped_unsafe') AS skipped,
cast(sum(coalesce(size, 0)) FILTER (role = 'keep') as bigint) AS size_to_keep, cast(sum(coalesce(size, 0)) FILTER (role = 'delete') as bigint) AS size_to_delete,
round(cast(sum(coalesce(size, 0)) FILTER (role = 'delete') as double) / cast(sum(coalesce(size, 0)) as double) * 100, 6) AS percentage_saved FROM o_reported""")
def _(b: Bridge):
    return reports.dedupe_stats(_reported(b, ("size",))).select(
        "total_groups", "items_to_delete", "deleted", "failed", "skipped", "size_to_keep", "size_to_delete",
        F.round("percentage_saved", 6).alias("percentage_saved"))


@query("group_age_flags", """SELECT group_id, arg_max(item_id, (date_added, role, item_id)) AS newest_id,
arg_max(role, (date_added, role, item_id)) = 'delete' AS newest_is_deleted, max(date_added) AS newest_date_added,
arg_min(item_id, (date_added, role, item_id)) AS oldest_id, arg_min(role, (date_added, role, item_id)) = 'keep' AS oldest_is_kept
FROM o_reported GROUP BY group_id""")
def _(b: Bridge):
    return reports.group_age_flags(_reported(b, ("date_added",))).select(
        "group_id", "newest_id", "newest_is_deleted", "newest_date_added", "oldest_id", "oldest_is_kept")


@query("decision_report_rows", """SELECT d.group_id, k.item_id AS keep_item, CASE WHEN k.is_ep THEN k.series_name || ' S' || k.season || 'E' || k.episode
WHEN length(k.name) > 15 THEN k.name[1:14] || '…' ELSE k.name END AS title, k.vcodec AS keep_codec, coalesce(k.size, 0) AS keep_size,
d.item_id AS delete_item, d.name = k.name AS same_name, CASE WHEN length(d.name) > 10 THEN d.name[1:9] || '…' ELSE d.name END AS delete_label,
CASE d.status WHEN 'success' THEN 'Deleted' WHEN 'failed' THEN 'Failed' ELSE 'Pending' END AS status_label
FROM o_reported d JOIN b_items k ON k.item_id = d.keep_id WHERE d.role = 'delete'""")
def _(b: Bridge):
    return reports.decision_report_rows(_reported(b))


@query("language_usage_summary", """SELECT CASE WHEN changed_by_language THEN 'kept for its ''' || priority_language_used || ''' audio over a better-rated copy (priorities: sk, cs, eng)'
WHEN selected_by_language THEN 'has ''' || priority_language_used || ''' audio and the best rating (priorities: sk, cs, eng)'
ELSE 'priorities (sk, cs, eng) did not change the choice' END AS message, count(*) AS n_groups, bool_or(selected_by_language) AS used,
bool_or(changed_by_language) AS changed FROM o_decisions WHERE role = 'keep' GROUP BY 1""")
def _(b: Bridge):
    return reports.language_usage_summary(_reported(b, ()), PRIORITIES)


@query("sink_decisions", """SELECT role, library, count(*) AS n_rows, cast(sum(coalesce(size, 0)) as bigint) AS bytes FROM o_reported GROUP BY ALL""")
def _(b: Bridge):
    path = shared_folder(b.spark, "decisions")
    sinks.write_decisions(_reported(b), path, "trial")
    return b.spark.read.parquet(path).where("run = 'trial'").groupBy("role", "library").agg(
        F.count("*").alias("n_rows"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


# ------------------------------------------------------------------ descriptive fields
@query("quality_description", """SELECT item_id, vcodec AS video_codec, coalesce(vbitrate::varchar, 'unknown') AS video_bitrate,
coalesce(video_range, 'unknown') AS video_range, acodec AS audio_codec, channels::varchar AS channels,
CASE WHEN lang1 IS NULL AND lang2 IS NULL THEN 'unknown' ELSE concat_ws(',', lang1, lang2) END AS languages, coalesce(size, 0) AS size,
coalesce(production_year::varchar, 'unknown') AS year, CASE WHEN is_ep THEN 'S' || season || 'E' || episode END AS episode_info,
starts_with(coalesce(dv_subtype, ''), 'DoviProfile5') AS is_dovi_p5 FROM b_items""")
def _(b: Bridge):
    q = select.quality_description()
    return b.items.withColumn("q", q).select(
        "item_id", F.col("q.video.codec").alias("video_codec"), F.col("q.video.bitrate").alias("video_bitrate"),
        F.col("q.video.video_range").alias("video_range"), F.col("q.audio.codec").alias("audio_codec"),
        F.col("q.audio.channels").alias("channels"), F.array_join("q.audio.languages", ",").alias("languages"),
        F.col("q.size").alias("size"), F.col("q.year").alias("year"), F.col("q.episode_info").alias("episode_info"),
        F.col("q.video.is_dovi_p5").alias("is_dovi_p5"))


@query("resolve_date_added", """SELECT item_id, coalesce(strftime(try_cast(date_created AS timestamp), '%Y-%m-%d %H:%M'), date_created,
strftime(try_cast(date_modified AS timestamp), '%Y-%m-%d %H:%M'), strftime(try_cast(premiere_date AS timestamp), '%Y-%m-%d'),
production_year || '-01-01 (year only)', 'unknown') AS date_added FROM b_items""")
def _(b: Bridge):
    from reelwright.functions.dates import resolve_date_added

    return b.items.select("item_id", resolve_date_added(
        F.col("date_created"), F.col("date_modified"), F.col("premiere_date"), F.col("end_date"),
        F.col("production_year")).alias("date_added"))


@query("resolution_label", """SELECT item_id, CASE WHEN height >= 2160 THEN '4K' WHEN height >= 1080 THEN '1080p' WHEN height >= 720 THEN '720p'
WHEN height >= 480 THEN '480p' ELSE width || 'x' || height END AS by_height, CASE WHEN width >= 3840 OR height >= 2160 THEN '2160p'
WHEN width >= 1920 OR height >= 1080 THEN '1080p' WHEN width >= 1280 OR height >= 720 THEN '720p' WHEN width >= 854 OR height >= 480 THEN '480p' END AS by_either
FROM b_items""")
def _(b: Bridge):
    v = first_stream(F.col("media_streams"), "Video")
    return b.items.select("item_id", quality.resolution_by_height(v["width"], v["height"]).alias("by_height"),
                          quality.resolution_by_either(v["width"], v["height"]).alias("by_either"))


@query("format_title", "SELECT item_id, CASE WHEN is_ep THEN series_name || ' - ' || name ELSE name END AS title FROM b_items")
def _(b: Bridge):
    return b.items.select("item_id", display.format_title(F.col("name"), F.col("series_name")).alias("title"))
