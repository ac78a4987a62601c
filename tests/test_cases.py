"""Small literal cases of the operators' rules."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from reelwright.functions import dates, display, quality, text
from reelwright.functions import paths as P
from reelwright.functions.streams import language_rank, normalize_priorities
from reelwright.operators import components, debounce, guard, index, inventory, localize, match, playback, retention, select
from reelwright.operators import gaps as G
from reelwright.operators import genres as GN
from reelwright.sources import snapshots
from reelwright.sources.events import item_added, parse_events
from reelwright.streaming.sessions import EVENTS, mark_paired


def values(spark, expr, rows, schema):
    df = spark.createDataFrame([(*r,) if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


# ---------------------------------------------------------------------------- file names
@pytest.mark.parametrize("name, expected", [
    ("Show S01E01.mkv", ("1", "1")), ("Show 1x01.mkv", ("1", "1")), ("show s01.e01.mkv", ("1", "1")),
    ("show s01_e02.mkv", ("1", "2")), ("show 101.mkv", ("1", "1")), ("show.mkv", (None, None)),
    ("Show S010E007.mkv", ("10", "7")), ("Show.720p.mkv", ("7", "20")), ("Show 1999.mkv", (None, None)),
    ("Show S00E00.mkv", ("0", "0")),
])
def test_episode_key(spark, name, expected):
    key = P.episode_key_from_filename(F.col("p"))
    row = values(spark, key, [f"/a/S09E09/{name}"], "p string")[0]
    assert (row["season"], row["episode"]) == expected


def test_red_flag_numbers_round_by_their_binary_value(spark):
    width, height, rate, codec = (F.col(c) for c in ("w", "h", "rate", "codec"))
    flag = quality.quality_red_flags(height, rate, quality.bits_per_pixel(rate, width, height), codec)
    rows = [(1920, 1080, 1150000, "h264"), (1920, 1080, 5750000, "h264"), (1920, 804, 231552, "mpeg4"), (400, 300, 231552, "h264"),
            (1920, 500, 57600, "h264"), (3840, 2160, 2250000, "hevc")]
    assert values(spark, flag["reason"], rows, "w int, h int, rate bigint, codec string") == [
        "1080p under-bitrate: 1.1 Mbps < 5.0 Mbps minimum", "", "720p under-bitrate: 0.2 Mbps < 3.0 Mbps minimum", "",
        "Critical BPP: 0.0025 < 0.05 minimum", "4K under-bitrate: 2.2 Mbps < 9.8 Mbps minimum"]
    low = F.col("x")
    shown = quality.quality_red_flags(F.lit(480), F.lit(1), low, F.lit("mpeg4"))["reason"]
    assert values(spark, shown, [231552 / (1920 * 804 * 24)], "x double") == ["Critical BPP: 0.0063 < 0.05 minimum"]


def test_no_table_of_titles_is_sent_through_the_driver(spark):
    titles = spark.range(300).select(F.concat(F.lit("Title "), F.col("id").cast("string")).alias("title"))
    pairs = match.title_pairs(titles, titles.where("title <> 'Title 7'"))
    assert pairs.where("`left` like '%7' and length(`left`) < 8").count() == 10
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert sum("LeftOuter" in line for line in joins) == 2  # an outer join sends its right side only, the heads
    assert sum("strategy=merge" in line for line in joins) == 2


def test_path_parts(spark):
    norm = values(spark, P.path_norm(F.col("p")), ["C:\\x\\y\\", "/a/b//", None, "/"], "p string")
    assert norm == ["C:/x/y", "/a/b", "", ""]
    assert values(spark, P.parent_dir(F.col("p")), ["/a/b/c.mkv", "/c.mkv", "c.mkv"], "p string") == ["/a/b", "/", ""]
    assert values(spark, P.stem(F.col("p")), ["a.b.mkv", ".mkv", "a", "a..mkv"], "p string") == ["a.b", ".mkv", "a", "a."]
    assert values(spark, P.ancestors(F.col("p")), ["/a/b/c"], "p string") == [["/a", "/a/b", "/a/b/c"]]


# -------------------------------------------------------------------------------- guard
def verdict(spark, keeper, delete, known, deletes):
    pairs = spark.createDataFrame([(keeper, delete)], "keeper_path string, delete_path string")
    paths = spark.createDataFrame([(p,) for p in known], "path string")
    gone = spark.createDataFrame([(p,) for p in deletes], "path string")
    return guard.delete_safe(pairs, paths, gone).collect()[0]["safe"]


@pytest.mark.parametrize("keeper, delete, others, deletes, safe", [
    ("/m/Film/x 4K.mkv", "/m/Film/y.mkv", [], [], False),                              # dedicated folder
    ("/m/Film/x.mkv", "/m/Film (P5)/y.mkv", [], [], True),                             # sibling folder
    ("/tv/S01/a 4K.mkv", "/tv/S01/b.mkv", ["/tv/S01/c.mkv"], [], True),                # loose in a season
    ("/tv/S01/a.mkv", "/tv/S01/b.mkv", ["/tv/S01/c.mkv"], ["/tv/S01/c.mkv"], False),   # co-deleted sibling
    ("/m/Film/Film 4K.mkv", "/m/Film/Film SD.mkv", ["/m/Film/z.mkv"], [], False),      # title's own folder
    ("/tv/S01/a.mkv", "/tv/S01/b.mkv", ["/tv/S01/sub/c.mkv"], [], False),              # nested neighbour
    ("\\tv\\S01\\a.mkv", "/tv/S01/b.mkv", ["/tv/S01/c.mkv"], [], True),                # backslashes
    ("/a.mkv", "/b.mkv", [], [], True),                                                # at the root
    (None, "/m/b.mkv", [], [], True), ("/m/a.mkv", None, [], [], True),
])
def test_delete_safe(spark, keeper, delete, others, deletes, safe):
    known = [p for p in (keeper, delete, *others) if p]
    gone = [p for p in (delete, *deletes) if p] or ["/none"]
    assert verdict(spark, keeper, delete, known, gone) is safe


def brute_delete_safe(keeper, delete, known, deletes):
    folder = delete.rsplit("/", 1)[0]
    if not folder or not keeper.startswith(folder + "/"):
        return True
    if delete.rsplit("/", 1)[1].rsplit(".", 1)[0].startswith(folder.rsplit("/", 1)[1]):
        return False
    return any(k.rsplit("/", 1)[0] == folder for k in set(known) - {keeper, delete} - set(deletes))


def test_cleanup_guard_against_brute_force(spark):
    rng = random.Random(7)
    tree = [f"/{'/'.join(rng.choice('ab') for _ in range(rng.randint(1, 3)))}/{rng.choice('abc')}{i}.mkv" for i in range(60)]
    deletes = tree[:25]
    survivors = [p for p in tree if p not in deletes]

    def expected(d):
        folder = d.rsplit("/", 1)[0]
        near = [s for s in survivors if s.startswith(folder + "/")]
        return all(brute_delete_safe(s, d, tree, deletes) for s in near)

    targets = spark.createDataFrame([(d,) for d in deletes], "delete_path string")
    known = spark.createDataFrame([(p,) for p in tree], "path string")
    got = guard.cleanup_delete_safe(targets, known, targets.withColumnRenamed("delete_path", "path")).collect()
    assert {r["delete_path"]: r["safe"] for r in got} == {d: expected(d) for d in deletes}


def test_fold_safe_plan(spark):
    minute = 600_000_000
    rows = [("g1", "a", 100 * minute, 100 * minute), ("g1", "b", 100 * minute, None), ("g2", "c", 100 * minute, 120 * minute),
            ("g2", "d", 6000 * 10**7, 6014 * 10**7), *[("g3", f"x{i}", 100 * minute, 100 * minute) for i in range(19)]]
    df = spark.createDataFrame(rows, "group_id string, item_id string, keep_runtime_ticks long, runtime_ticks long").select(
        "*", F.lit(False).alias("safe"), F.lit("r").alias("reason"), F.concat(F.lit("/k/"), "group_id").alias("keeper_path"),
        F.concat(F.lit("/d/"), "item_id").alias("delete_path"))
    got = {r["item_id"]: (r["status"], r["review_reason"]) for r in guard.fold_safe_plan(df).collect()}
    assert got["a"] == ("ok", "") and got["d"] == ("ok", "")
    assert got["b"][1] == "duration unknown" and got["c"][1].startswith("duration mismatch (keeper 6000s, delete 7200s")
    assert all(got[f"x{i}"] == ("needs_review", "group too large (19 planned deletes)") for i in range(19))


def test_owned_folder_and_output(spark):
    files = spark.createDataFrame([(p,) for p in (
        "/m/Film/Film 4K.mkv", "/m/Film/other.mkv", "/tv/Show/Season 1/Show S01E01/Show S01E01 x.mkv",
        "/m/box/a.mkv", "/m/box/a [HDR10].mkv", "/m/box/a-trailer.mkv", "/m/box/notes.txt", "/m/shared/p.mkv", "/m/shared/q.mkv")], "path string")
    rows = guard.safe_output_path(guard.owned_folder(files)).collect()
    got = {r["path"]: (r["owned"], r["output_path"]) for r in rows}
    assert got["/m/Film/Film 4K.mkv"] == (True, "/m/Film 4K [HDR10]/Film 4K [HDR10].mkv")
    assert got["/tv/Show/Season 1/Show S01E01/Show S01E01 x.mkv"] == (True, "/tv/Show/Season 1/Show S01E01 x [HDR10].mkv")
    assert got["/m/box/a.mkv"] == (True, "/m/a [HDR10]/a [HDR10].mkv")
    assert got["/m/shared/p.mkv"] == (False, "/m/shared/p [HDR10].mkv")


# ------------------------------------------------------------------------------ quality
def score(spark, **given):
    base = dict(megapixels=2.07, height=1080, hdr=0.0, bitrate_mbps=10.0, channels=6, date_rating=0, codec="h264",
                source=1.0, ai_upscale=False, dovi_p5=False, size_bytes=0, duration_minutes=None)
    row = {**base, **given}
    casts = {"codec": "string", "size_bytes": "bigint", "duration_minutes": "double", "date_rating": "bigint"}
    cols = {k: F.lit(v).cast(casts[k]) if k in casts else F.lit(v) for k, v in row.items()}
    return spark.range(1).select(quality.quality_score(**cols).alias("s")).collect()[0]["s"]


def test_score_invariants(spark):
    uhd = score(spark, megapixels=8.29, height=2160, bitrate_mbps=25.0, codec="hevc")
    remux = score(spark, bitrate_mbps=30.0, source=1.3)
    assert uhd["total"] > remux["total"]
    assert score(spark, megapixels=8.29, height=2160, hdr=1.0, dovi_p5=True)["total"] < score(spark)["total"]
    assert not score(spark, bitrate_mbps=0.0)["starved"]
    starved = score(spark, bitrate_mbps=1.0)
    assert starved["starved"] and starved["resolution_credit"] == pytest.approx(2.07 * (1.0 / 2.5) * 10)
    assert not score(spark, bitrate_mbps=2.0, codec="hevc")["starved"]
    s = score(spark, hdr=1.0, source=1.15, ai_upscale=True)
    parts = s["resolution_credit"] + s["hdr"] + s["bitrate"] + s["audio"] + s["date"]
    assert parts * s["source_multiplier"] * s["ai_multiplier"] * s["dovi_p5_multiplier"] == pytest.approx(s["total"])


def test_names_and_markers(spark):
    tiers = values(spark, quality.source_tier(F.col("p"), F.lit("x REMUX")),
                   ["a.bdremux.mkv", "a.blu-ray.mkv", "a.webrip.mkv", "a.pdtv.mkv", "a.mkv", "", None], "p string")
    assert tiers == ["bluray_remux", "bluray", "webdl", "hdtv", "unknown", "bluray_remux", "bluray_remux"]
    marks = values(spark, quality.hdr_marker(F.col("p")), ["a.HDR10+.x", "a.HDRip", "DVDRip", "Dolby.Vision", "DV", None], "p string")
    assert marks == [True, False, False, True, False, False]
    assert normalize_priorities(["Slovak", "slo", "cze", "en"]) == ["sk", "cs", "en"]
    ranks = values(spark, language_rank(F.col("l"), ["sk", "cs"]), [(["CZE", "slovak"],), (["ces"],), (["en"],), ([],)], "l array<string>")
    assert ranks == [0, 1, 9999, 9999]


# ---------------------------------------------------------------------------- selection
def copies(spark, rows):
    return spark.createDataFrame(rows, "group_id string, item_id string, rating double, languages array<string>").select(
        "*", language_rank(F.col("languages"), ["sk", "cs"]).alias("lang_rank"),
        F.when(F.array_contains("languages", "slo"), "sk").alias("priority_language"))


def test_smart_override(spark):
    rows = [("one", "a", 10.0, ["slo"]), ("one", "b", 26.0, ["eng", "ger"]),            # single against several, > 2.5
            ("none", "a", 10.0, ["slo", "eng"]), ("none", "b", 49.0, ["eng"]),          # no priority language, <= 5
            ("both", "a", 10.0, ["slo", "eng"]), ("both", "b", 41.0, ["cze"]),          # both, > 4
            ("zero", "a", 0.0, ["slo", "eng"]), ("zero", "b", 1.0, ["eng"]),            # nothing to divide by
            ("tie", "b", 5.0, ["eng"]), ("tie", "a", 5.0, ["eng"])]
    got = {r["group_id"]: (r["override"], r["keep_id"]) for r in select.smart_override(copies(spark, rows)).collect()}
    assert got == {"one": (True, "b"), "none": (False, "a"), "both": (True, "b"), "zero": (True, "b"), "tie": (False, "a")}


def test_duplicate_keys(spark):
    schema = "provider string, pid string, item_id string, library string, is_episode boolean, series_name string, season int, episode int"
    rows = [("imdb", "tt1", x, "L", False, None, None, None) for x in "abc"] + [("imdb", "tt2", "d", "L", False, None, None, None)]
    rows += [("tmdb", "9", "e", "L", True, "S", 1, 1), ("tmdb", "9", "f", "L", True, "S", 1, 2), ("tmdb", "9", "g", "L", True, "S", 1, 2)]
    table = spark.createDataFrame(rows, schema)
    assert {(r["pid"], r["n_items"]) for r in index.identify_duplicates(table, ["tt9"]).collect()} == {("tt1", 3), ("9", 3)}
    assert {tuple(r) for r in index.duplicate_edges(table).collect()} == {("b", "a"), ("c", "a"), ("g", "f")}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    nodes = [f"n{i:03d}" for i in range(300)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(220)]
    edges += [("hub", n) for n in nodes[:100]] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for n in list(parent):
        groups.setdefault(find(n), set()).add(n)
    expected = {n: min(g) for g in groups.values() if len(g) > 1 for n in g}
    rows = components.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r["item_id"]: r["component"] for r in rows} == expected
    assert len(rows) == len(expected)


def test_hot_key_join_is_split(spark):
    """A third of the rows on one key: the join back to the group's value splits that partition."""
    from reelwright.operators.grouping import attach_group_values

    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 600000, 1, 6).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("g"),
            F.md5(F.col("id").cast("string")).alias("item_id"))
        out = attach_group_values(rows, ["g"], n=F.count("*"))
        assert out.where("g = 'hot'").select("n").first()["n"] == 200000
        total = out.agg(F.count("*").alias("n"), F.max("item_id").alias("last"))
        assert total.collect()[0]["n"] == 600000
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_first_per_key_limits_before_the_shuffle(spark):
    """A hot key reaches the shuffle with one row per input partition."""
    from reelwright.operators.grouping import first_per_key

    rows = spark.range(0, 1000, 1, 4).select((F.col("id") % 3).alias("g"), "id")
    out = first_per_key(rows, ["g"], [F.col("id").desc()])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert {(r["g"], r["id"]) for r in out.collect()} == {(0, 999), (1, 997), (2, 998)}


# ---------------------------------------------------------------------------- retention
def test_retention_rules(spark):
    p = retention.RetentionParams(as_of="2026-01-01")
    got = values(spark, retention.rating_threshold(F.col("a"), p), [3.0, 4.0, 5.0, 6.0, 7.0, 20.0], "a double")
    assert got == [6.0, 6.5, 7.0, 7.5, 8.0, 8.0]
    rate = retention.effective_rating(F.col("a"), F.col("b"))
    assert values(spark, rate, [(5.0, 80.0), (5.0, None), (None, 80.0), (None, None)], "a double, b double") == [6.5, 5.0, 8.0, 0.0]
    assert values(spark, dates.age_years(F.col("a"), "2026-01-01"), ["bad", None, "2026-01-01T00:00:00Z"], "a string") == [0.0, 0.0, 0.0]
    days = retention.days_until_candidate(F.col("r"), F.col("a"), p)
    assert values(spark, days, [(9.5, 20.0), (7.0, 4.0), (8.5, 11.0), (6.0, 5.0)], "r double, a double") == [None, 365, 365, 0]


def test_path_beats_masterpiece_gate(spark):
    schema = ("item_id string, path string, provider_ids map<string,string>, people array<struct<name:string,type:string>>, "
              "date_created string, community_rating double, critic_rating double")
    actor = [("Ann", "Actor")]
    rows = [("path", "/x/Dokumenty/a", {}, [], "2000-01-01", 1.0, None), ("old", "/x/a", {}, actor, "2000-01-01", 8.9, None),
            ("gem", "/x/a", {}, [], "2000-01-01", 9.0, None), ("actor", "/x/a", {}, actor, "2020-01-01", 1.0, None),
            ("franchise", "/x/a", {"TMDBcollection": "1"}, [], "2020-01-01", 1.0, None), ("young", "/x/a", {}, [], "2025-01-01", 1.0, None),
            ("ex", "/x/a", {"Imdb": "tt1"}, [], "2020-01-01", 1.0, None), ("played", "/x/a", {}, [], "2000-01-01", 1.0, None)]
    movies = spark.createDataFrame(rows, schema)
    status = spark.createDataFrame([("played", True, True)], "item_id string, played boolean, interested boolean")
    p = retention.RetentionParams(as_of="2026-01-01", excluded_provider_ids=("tt1",))
    got = retention.classify_movies(movies, status, spark.createDataFrame([("Ann",)], "name string"), p)
    assert {r["item_id"]: r["stage"] for r in got.collect()} == {
        "path": "path_protected", "old": "candidate", "gem": "rating_protected", "actor": "actor_protected",
        "franchise": "franchise_protected", "young": "age_filtered", "ex": "excluded_filtered", "played": "play_protected"}


# ----------------------------------------------------------------------------- matching
def test_titles(spark):
    got = values(spark, text.normalize_title(F.col("t")), ["The  Film: Part-2!", "komédia: x", "!!!"], "t string")
    assert got == ["the film part2", "komédia x", ""]


def test_title_pairs_against_brute_force(spark):
    rng = random.Random(11)
    words = ["a", "an", "the", "man", "manic", "it", "she", "hero", "heroes", "2", "21"]
    left = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["!!"]
    right = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["??"]

    def clean(t):
        return "".join(c for c in t if c.isalnum() or c == " ").strip()

    a, b = {clean(t) for t in left}, {clean(t) for t in right}
    expected = {(x, y) for x in a for y in b if x == y or (x and y and (x in y or y in x))}
    got = match.title_pairs(spark.createDataFrame([(t,) for t in left], "title string"),
                            spark.createDataFrame([(t,) for t in right], "title string")).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_native_over_upscale(spark):
    schema = "upscaled boolean, native_tier double, pixels long, size long"
    native, upscale = (False, 1.15, 1920 * 1080, 30), (True, 0.95, 3840 * 2160, 20)

    def run(proposed, existing, recommendation):
        df = spark.createDataFrame([(proposed, existing)], f"p struct<{schema.replace(' ', ':').replace(',:', ',')}>, e struct<{schema.replace(' ', ':').replace(',:', ',')}>")
        return df.select(match.native_over_upscale(F.col("p"), F.col("e"), F.lit(recommendation))).first()[0]

    assert run(native, upscale, "skip") == "download"
    assert run(upscale, native, "download") == "skip"
    assert run((False, 1.0, 1920 * 1080, 30), upscale, "skip") == "skip"
    assert run((False, 1.15, 1920 * 1080, 29), upscale, "skip") == "skip"


# -------------------------------------------------------------------- gaps, genres, text
def test_missing_groups(spark):
    rows = [("1", "v", "Show", 1, 1, "A", "2020-01-02"), ("2", "v", "Show", 1, 1, "B", "2020-01-01"),
            ("3", "v", "Show", 2, None, "C", None), ("4", "w", None, None, 3, "D", "x")]
    df = spark.createDataFrame(rows, "id string, series_id string, series_name string, season int, episode int, name string, air_date string")
    kept = G.missing_dedupe(df)
    assert {(r["series_name"], r["season"], r["episode"], r["id"]) for r in kept.collect()} == {
        ("Show", 1, 1, "2"), ("Show", 2, 0, "3"), ("Unknown Series", 0, 3, "4")}
    stats = G.missing_stats(kept).first()
    assert (stats["total_missing_episodes"], stats["total_series_affected"], stats["total_seasons_affected"],
            stats["most_missing_series"], stats["average_missing_per_series"]) == (3, 2, 3, "Show", 1.5)
    empty = G.missing_stats(kept.where("false")).first()
    assert (empty["total_missing_episodes"], empty["most_missing_series"]) == (0, "None")


def test_genres(spark):
    got = values(spark, GN.normalize_genres(F.col("g")), [(["SCI-FI", "sf", "Weird", "Suspense", "Thriller"],), (None,)], "g array<string>")
    assert got == [["Science Fiction", "Weird", "Thriller"], []]
    got = values(spark, GN.expand_compound_genres(F.col("g")), [(["Sci-Fi & Fantasy", "TV Movie", "horor", "Fantasy"],)], "g array<string>")
    assert got == [["Science Fiction", "Fantasy", "Horror"]]
    assert values(spark, GN.split_genre_text(F.col("g")), [" Drama, sf ,N/A,,Drama"], "g string") == [["Drama", "Science Fiction"]]
    row = values(spark, GN.compare_genres(F.col("a"), F.col("b")), [(["sf", "War"], ["Drama", "Science Fiction"])], "a array<string>, b array<string>")[0]
    assert (row["missing"], row["extra"], row["merged"], row["has_diff"]) == (["Drama"], ["War"], ["Drama", "Science Fiction", "War"], True)


def test_language_chain(spark):
    schema = "loc map<string,struct<overview:string,title:string,year:string>>, cur string"
    loc = {"en-US": ("en", "Hero", "1999"), "cs-CZ": ("cs", "", ""), "sk-SK": ("", "", "2001")}
    only_en = {"en-US": ("en", "Hero", "")}
    pick = localize.pick_by_language_chain(F.col("loc"), "overview", F.col("cur"))
    got = values(spark, pick, [(loc, "x"), (only_en, "x"), (only_en, " "), (None, "")], schema)
    assert [tuple(g) if g else None for g in got] == [("cs", "cs-CZ"), None, ("en", "en-US"), None]
    assert values(spark, localize.pick_year(F.col("loc")), [(loc, ""), (only_en, ""), (None, "")], schema) == [1999, None, None]
    title = localize.pick_title(F.col("cur"), F.lit("de"), F.col("loc"))
    assert values(spark, title, [(loc, "Held"), (loc, "HERO "), (only_en, "")], schema) == ["Hero", None, None]


def test_freshness(spark):
    ts = dt.datetime(2024, 1, 1)
    snap = spark.createDataFrame([("fresh", ts, "x"), ("neg", ts, None), ("old", ts - dt.timedelta(days=40), "x"), ("bad", None, "x")],
                                 "key string, fetched_at timestamp, data string")
    asked = spark.createDataFrame([(k,) for k in ("fresh", "neg", "old", "bad", "new")], "key string")
    got = snapshots.snapshot_freshness(asked, snap, "2024-01-10 00:00:00", "data")
    assert dict(got.collect()) == {"fresh": "fresh", "neg": "negative", "old": "stale", "bad": "stale", "new": "missing"}
    assert {r["key"] for r in snapshots.refresh_list(got).collect()} == {"old", "bad", "new"}


def test_display(spark):
    sizes = values(spark, display.format_size(F.col("s")), [0, None, 512, 1152, 5 * 1024**3, 3 * 1024**6], "s long")
    assert sizes == ["0 B", "0 B", "512.00 B", "1.12 KB", "5.00 GB", "3072.00 PB"]
    assert values(spark, display.format_days_left(F.col("d")), [None, 0, 29, 364, 400], "d int") == ["never", "now", "29d", "12mo", "1.1yr"]


# ----------------------------------------------------------------------- playback, events
def loop_sessions(events):
    """The pairing rule, one user and item at a time."""
    out, i = [], 0
    events = sorted(events, key=lambda e: (e[0], e[1]))
    while i < len(events):
        ts, event_id, kind = events[i]
        if kind == "playback.start":
            stop = next((j for j in range(i + 1, len(events)) if events[j][2] == "playback.stop"), None)
            out.append((event_id, events[stop][0] if stop is not None else None))
            if stop is not None:
                i = stop
        i += 1
    return out


@pytest.mark.parametrize("chunk", [600, 3600, 10**7])
def test_sessions_against_loop(spark, chunk):
    rng = random.Random(chunk)
    base = dt.datetime(2024, 3, 1)
    rows, by_key = [], {}
    for n in range(900):
        key = ("hot", "hot") if n % 3 == 0 else (f"u{rng.randint(0, 8)}", f"i{rng.randint(0, 2)}")
        ts = base + dt.timedelta(seconds=rng.randint(0, 30000))
        kind = rng.choice(["playback.start", "playback.start", "playback.stop"])
        rows.append((n, kind, ts, *key, f"x{n}"))
        by_key.setdefault(key, []).append((ts, n, kind))
    df = spark.createDataFrame(rows, "event_id long, type string, ts timestamp, user_id string, item_id string, name string")
    got = {(r["user_id"], r["item_id"], r["event_id"], r["stop_ts"]) for r in playback.playback_sessions(df, chunk_seconds=chunk).collect()}
    expected = {(*k, e, s) for k, events in by_key.items() for e, s in loop_sessions(events)}
    assert got == expected


@pytest.mark.parametrize("slots", [1, 3, 4096])
def test_quiet_batches_against_loop(spark, monkeypatch, slots):
    monkeypatch.setattr(debounce, "RANGE_SLOTS", slots)
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    stamps = sorted(base + dt.timedelta(seconds=rng.randint(0, 60000)) for _ in range(200))
    starts, ends, start = {}, {}, None
    for before, ts in zip([None, *stamps], stamps):
        if before is None or (ts - before).total_seconds() >= 300:
            start = ts
        starts[ts], ends[start] = start, ts
    df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp")
    got = {r["ts"]: (r["batch_start"], r["batch_end"]) for r in debounce.quiet_batches(df).collect()}
    assert got == {ts: (s, ends[s]) for ts, s in starts.items()}


def test_sessions_wait_for_their_stop(spark):
    base = dt.datetime(2024, 1, 1)
    hours = [("playback.start", 0), ("playback.start", 1), ("playback.stop", 2), ("playback.start", 3), ("playback.stop", 60)]
    rows = [(n, kind, base + dt.timedelta(hours=h), "u", "i", "x") for n, (kind, h) in enumerate(hours)]
    rows.append((9, "playback.start", base, "v", "i", "x"))
    df = spark.createDataFrame(rows, EVENTS)

    def settled(clock_hours: int, hold_hours: int) -> set[int]:
        clock = F.lit(base + dt.timedelta(hours=clock_hours))
        return {r["event_id"] for r in mark_paired(df, clock, hold_hours * 3600).where("settled").collect()}

    assert settled(1, 10) == set()
    assert settled(2, 10) == {0, 1, 2}
    assert settled(12, 10) == {0, 1, 2, 9}
    assert settled(13, 10) == {0, 1, 2, 3, 9}
    assert settled(60, 1000) == {0, 1, 2, 3, 4}


def test_ranks_of_a_hot_set(spark):
    rng = random.Random(3)
    rows = [(None if n % 3 else n % 7, f"i{n:03d}", rng.randint(0, 2), float(rng.randint(0, 3))) for n in range(300)]
    df = spark.createDataFrame(rows, "s int, item_id string, lang_rank int, neg double").select(
        "s", "item_id", F.struct("lang_rank", "neg").alias("copy"))
    expected = {}
    for s in {r[0] for r in rows}:
        for rank, r in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[3], r[1])), 1):
            expected[r[1]] = rank
    assert {r["item_id"]: r["rank"] for r in match.rank_candidates(df, ["s"]).collect()} == expected


def test_event_bodies(spark):
    bodies = ['{"Event":"library.new","Item":{"Type":"Episode","Id":"7","Name":"Pilot","SeriesId":"s1","SeriesName":"Show"}}',
              '{"event":"item.add","Metadata":{"ratingKey":"8","title":"Film"}}', '{"Event":"Item.Added","Item":{"Type":"Episode","Id":"9","Name":"Solo"}}',
              'junk "Event" : "library.new" more "Id":"10" "Name":"Raw"', '{"Event":"playback.start","Item":{"Id":"11"}}', '{"Event":"library.new","Item":{}}']
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), b) for b in bodies], "ts timestamp, body string")
    got = {(r["desc_id"], r["desc_name"], r["genre_id"], r["genre_name"]) for r in item_added(parse_events(df)).collect()}
    assert got == {("7", "Show – Pilot", "s1", "Show"), ("8", "Film", "8", "Film"), ("9", "unknown – Solo", "9", "Solo"), ("10", "Raw", "10", "Raw")}


def test_urls(spark):
    own = text.strip_url_credentials(F.col("u"), ["x-server-token"])
    assert values(spark, own, ["http://h/p?X-Server-Token=s&a=1&x-auth-token=z"], "u string") == ["http://h/p?a=1&x-auth-token=z"]
    urls = ["http://h/p?a=1&API_KEY=s&b=2#f", "http://h/p?api_key=s", "http://h/p", None]
    assert values(spark, text.strip_url_credentials(F.col("u")), urls, "u string") == ["http://h/p?a=1&b=2#f", "http://h/p", "http://h/p", None]
    assert values(spark, text.extract_url_key(F.col("u")), urls, "u string") == ["s", "s", None, None]


def test_guard_counts_a_path_in_two_spellings_once(spark):
    known = spark.createDataFrame([("/m/shared/K.mkv",), ("\\m\\shared\\K.mkv",), ("/m/shared/D.mkv",)], "path string")
    deletes = spark.createDataFrame([("/m/shared/D.mkv",)], "path string")
    pairs = spark.createDataFrame([("/m/shared/K.mkv", "/m/shared/D.mkv")], "keeper_path string, delete_path string")
    assert [r.safe for r in guard.delete_safe(pairs, known, deletes).collect()] == [False]
    targets = pairs.select("delete_path")
    assert [r.safe for r in guard.cleanup_delete_safe(targets, known, deletes).collect()] == [False]


def test_repeated_marks_keep_one_row_per_path(spark):
    state = spark.createDataFrame([("a", "ok"), ("b", "ok")], "path string, status string")
    marks = spark.createDataFrame([("a", "ignored"), ("a", "ignored"), ("b", "bogus")], "path string, status string")
    assert sorted(map(tuple, inventory.mark_status(state, marks).select("path", "status").collect())) == [
        ("a", "ignored"), ("b", "ok")]
    assert inventory.refused_marks(marks).count() == 1


def test_components_of_long_chains_and_stars(spark):
    """A shuffled chain of 3,000 nodes, a star of 3,000 around a middle name, and a star of stars, over many partitions."""
    rng = random.Random(5)
    names = rng.sample(range(100_000), 9_000)
    chain, star, far = names[:3000], names[3000:6000], names[6000:]
    edges = list(zip(chain, chain[1:])) + [(star[1500], n) for n in star] + [(far[i // 50], far[i]) for i in range(1, 3000)]
    rng.shuffle(edges)
    found = components.connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(7)).collect()
    want = {n: min(g) for g in (chain, star, far) for n in g}
    assert {r["item_id"]: r["component"] for r in found} == want and len(found) == len(want)


def test_components_go_on_from_known_labels(spark):
    old = components.connected_components(spark.createDataFrame([(5, 7), (7, 9), (1, 2)], "src long, dst long"))
    new = spark.createDataFrame([(9, 2), (20, 21), (None, 5)], "src long, dst long")
    found = components.connected_components(new, old).collect()
    assert {r["item_id"]: r["component"] for r in found} == {1: 1, 2: 1, 5: 1, 7: 1, 9: 1, 20: 20, 21: 20}
    assert components.connected_components(new.where("false")).count() == 0


def test_a_task_keeps_few_edges_in_memory(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(500)]
    monkeypatch.setattr(components, "EDGES_AT_ONCE", 50)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([b for _, b in edges[i:i + 20]]), pa.array([a for a, _ in edges[i:i + 20]])], ["u", "v"])
               for i in range(0, 500, 20)]
    sent = list(components._contracted(iter(batches)))
    assert len(sent) > 3 and components.forest(p for b in sent for p in zip(*(c.to_pylist() for c in b.columns))) == {i: 0 for i in range(1, 501)}


def test_tasks_join_edges_on_arrays_as_pair_by_pair():
    import pyarrow as pa

    rng = random.Random(9)
    names = [f"{c}{i}" for c in ("a", "é", "z", "\U0001f600") for i in range(60)]
    pairs = [sorted(rng.sample(names, 2), reverse=True) for _ in range(150)]
    rng.shuffle(pairs)
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs[i:i + 40]]), pa.array([x[1] for x in pairs[i:i + 40]])], ["u", "v"])
               for i in range(0, 150, 40)]
    sent = [p for b in components._contracted(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert dict(sent) == components.forest(iter(pairs)) and len(dict(sent)) == len(sent)


def test_edges_of_an_item_come_out_in_one_partition(spark):
    entries = spark.range(400).select(
        F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), (F.col("id") % n).cast("string").alias("pid"))
                            for p, n in (("imdb", 40), ("tmdb", 50), ("tvdb", 70))])).alias("e"),
        F.format_string("%03d", "id").alias("item_id"), F.lit(False).alias("is_episode"),
        F.lit(None).cast("string").alias("series_name"), F.lit(None).cast("int").alias("season"), F.lit(None).cast("int").alias("episode"),
    ).select("e.*", "item_id", "is_episode", "series_name", "season", "episode")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        edges = index.duplicate_edges(entries).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({(e["src"], e["dst"]) for e in edges}) == len(edges) > 900
    assert len({(e["src"], e["at"]) for e in edges}) == len({e["src"] for e in edges}) < len(edges)


def test_groups_are_verified_with_one_join_of_the_members(spark):
    rows = [("a", "1", True, "X|S1E1"), ("a", "2", True, "X|S1E1"), ("a", "3", True, "X|S1E2"), ("a", "4", False, None), ("a", "5", False, None),
            ("b", "6", False, None), ("b", "7", False, "NON"), ("c", "8", None, "q"), ("c", "9", None, "r"), ("d", "10", True, ""), ("d", "11", True, "")]
    members = spark.createDataFrame(rows, "component string, item_id string, is_episode boolean, series_key string")
    groups = select.verify_groups(members)
    assert {(r["group_id"], r["item_id"]) for r in groups.collect()} == {
        ("1", "1"), ("1", "2"), ("6", "6"), ("6", "7"), ("8", "8"), ("8", "9"), ("10", "10"), ("10", "11")}
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2


def test_file_names_are_searched_once(spark):
    names = ["Show S01E02 3x04.mkv", "3x04 then s05e06", "a 101 b s1.e2", "s2_e3 and 405", "Show 000x000", "x 1234 y", "", None, "two\nlines 007X08", "S1E"]
    found = spark.createDataFrame([("/f/" + n if n is not None else None,) for n in names], "p string").select(
        P.episode_key_from_filename(F.col("p")).alias("k"))
    assert [(r["k"]["season"], r["k"]["episode"]) for r in found.collect()] == [
        ("1", "2"), ("5", "6"), ("1", "2"), ("2", "3"), ("0", "0"), (None, None), (None, None), (None, None), ("7", "8"), (None, None)]
    keyed = select.with_episode_key(spark.createDataFrame(
        [("S", "/f/a 1x2"), ("", "/f/a 1x2"), (None, "/f/a 1x2"), ("S", ""), ("S", None), ("S", "/f/a")], "series_name string, path string"))
    assert [r["_key"] for r in keyed.collect()] == ["S|S1E2", None, None, None, None, None] and keyed.columns == ["series_name", "path", "_key"]
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") == 1 and "RLIKE" not in plan


def dedupe_items(spark):
    """Two films with two copies each in a shared folder, one copy without streams."""
    from reelwright.schemas import ITEMS

    rows = [{"item_id": str(i), "name": f"T{i % 2}", "path": f"/m/shared/T{i % 2} {i}.mkv", "library": "L", "is_folder": False, "size": 10 * i,
             "provider_ids": {"Imdb": f"tt{i % 2}"}, "date_created": f"2020-01-0{i}T00:00:00", "runtime_ticks": 600000000,
             "media_streams": [{"type": "Video", "width": 1920, "height": 1080, "codec": "h264", "bit_rate": 1000000 * i}] if i < 6 else None}
            for i in range(1, 7)]
    return spark.createDataFrame(rows, ITEMS)


def test_streams_are_rated_before_they_are_joined(spark):
    from reelwright.plans import dedupe

    rated = dedupe.rated_members(dedupe_items(spark))
    assert {r["item_id"] for r in rated.collect()} == {"1", "2", "3", "4", "5"}
    chosen = select.smart_override(rated)
    assert {(r["group_id"], r["keep_id"], r["n_items"]) for r in chosen.collect()} == {("1", "5", 3), ("2", "4", 2)}
    waiting, joins = [chosen._jdf.queryExecution().optimizedPlan()], 0
    while waiting:
        node = waiting.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joins += 1
            assert not any("media_streams" in x.output().mkString(",") for x in below)
        waiting += below
    assert joins


def test_decisions_are_written_with_the_columns_that_are_read(spark):
    from reelwright.plans import dedupe

    items = dedupe_items(spark)
    full, few = dedupe.guarded_decisions(items), dedupe.guarded_decisions(items, columns=("size",))
    assert "date_added" in full.columns and "rating" in full.columns
    dropped = {"rating", "languages", "lang_rank", "priority_language", "library", "is_episode", "series_name", "season", "episode",
               "provider_id", "tmdb_id", "date_added", "codec"}
    assert set(full.columns) - set(few.columns) == dropped and set(few.columns) <= set(full.columns)
    assert sorted(map(str, full.select(few.columns).collect())) == sorted(map(str, few.collect())) and few.count() == 5
    rated = dedupe.decide(items, columns=("rating",))
    assert sorted(map(str, rated.collect())) == sorted(map(str, dedupe.decide(items).select(rated.columns).collect()))


def test_surviving_paths_are_compared_by_their_hash(spark):
    known = spark.createDataFrame([("/m/a/1.mkv",), (r"\m\a\1.mkv",), ("/m/a/2.mkv/",), ("/m/a/2.mkv",), ("/m/b/3.mkv",)], "path string")
    found = guard.surviving_paths(known, spark.createDataFrame([("/m/b/3.mkv",), ("/m/b/3.mkv/",)], "path string"))
    assert sorted(map(tuple, found.collect())) == [("/m/a/1.mkv", "/m/a"), ("/m/a/2.mkv", "/m/a")] and found.columns == ["npath", "dir"]
    assert "_hash" in found._jdf.queryExecution().executedPlan().toString()


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


# ------------------------------------------------------------------- snapshots and stores
def test_a_broken_write_leaves_the_old_version(spark, tmp_path):
    from reelwright.sources import snapshots

    path, schema = str(tmp_path / "snapshot"), "key string, n int"
    assert snapshots.read_snapshot(spark, path, schema).count() == 0
    snapshots.write_snapshot(spark.createDataFrame([("a", 1), ("b", 2)], schema), path)

    def breaks(batches):
        for i, batch in enumerate(batches):
            if i or batch.num_rows:
                raise ValueError("lost half-way")
            yield batch

    bad = spark.createDataFrame([("c", 3)] * 10, schema).repartition(4).mapInArrow(breaks, schema)
    with pytest.raises(Exception, match="half-way"):
        snapshots.write_snapshot(bad, path)
    # A version that is whole but not committed is not read either.
    spark.createDataFrame([("d", 4)], schema).write.parquet(f"{path}/versions/99999999999999999999-x")
    old = snapshots.read_snapshot(spark, path, schema)
    assert sorted(map(tuple, old.collect())) == [("a", 1), ("b", 2)]
    # The next version may read the one before, and the oldest expire.
    for n in range(4):
        now = snapshots.read_snapshot(spark, path, schema)
        snapshots.write_snapshot(snapshots.merge_snapshot(now, spark.createDataFrame([("a", n), (f"k{n}", n)], schema)), path, keep=2)
    assert sorted(map(tuple, snapshots.read_snapshot(spark, path, schema).collect())) == sorted(
        [("a", 3), ("b", 2)] + [(f"k{n}", n) for n in range(4)])
    assert len(snapshots.committed_versions(spark, path)) == 2


def test_store_rewrites_only_the_buckets_it_is_given(spark, tmp_path):
    import datetime as dt
    import glob

    from reelwright.sources import snapshots

    path, at = str(tmp_path / "store"), dt.datetime(2024, 1, 1)
    rows = [("genres", f"k{i}", ["x"], at) for i in range(300)] + [("genres", None, ["x"], at)]
    snapshots.merge_store(path, spark.createDataFrame(rows, snapshots.STORE))
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    new = [("genres", "k7", [], at + dt.timedelta(days=9)), ("genres", "k8", ["old"], at - dt.timedelta(days=9)), ("texts", "k7", None, at)]
    snapshots.merge_store(path, spark.createDataFrame(new, snapshots.STORE))
    left = {f for f in glob.glob(f"{path}/bucket=*/*.parquet") if before.get(f) == os.path.getmtime(f)}
    assert len(before) - len(left) <= 3 and len(left) > 50
    asked = spark.createDataFrame([("genres", "k7"), ("genres", "k8"), ("texts", "k7"), ("genres", "none"), ("genres", None)], "namespace string, key string")
    got = {(r.namespace, r.key): (r.status, r.value) for r in snapshots.look_up(asked, snapshots.read_store(spark, path), "2024-01-20 00:00:00").collect()}
    assert got == {("genres", "k7"): ("negative", None), ("genres", "k8"): ("fresh", ["x"]), ("texts", "k7"): ("negative", None),
                   ("genres", "none"): ("missing", None), ("genres", None): ("missing", None)}


# ------------------------------------------------------------------------- waiting rows
def test_waiting_work_follows_new_and_settled_rows(spark, tmp_path):
    """Many held starts; a later micro-batch of one user reads and rewrites one bucket, and pairs as ever."""
    import datetime as dt

    from reelwright.streaming import sessions, waiting

    start, base = dt.datetime(2024, 1, 1), str(tmp_path)
    schema = sessions.EVENTS
    kind = {True: sessions.PLAYBACK_START, False: sessions.PLAYBACK_STOP}

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        out = {}

        def emit(found, batch_id):
            out[batch_id] = [tuple(r) for r in found.select("user_id", "item_id").collect()]

        sessions.run_sessions(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/state", f"{base}/checkpoint", emit).awaitTermination()
        return out

    held = [(i, kind[True], start + dt.timedelta(seconds=i), f"u{i}", "m", "film") for i in range(200)]
    assert feed(held) == {0: []}
    first = waiting.read_manifest(spark, f"{base}/state", 0)
    assert len(first) > 40
    later = start + dt.timedelta(hours=1)
    assert feed([(900, kind[False], later, "u5", "m", "film"), (901, kind[True], later + dt.timedelta(hours=2), "u5", "n", "film")]) == {1: [("u5", "m")]}
    second = waiting.read_manifest(spark, f"{base}/state", 1)
    rewritten = {b for b, r in second.items() if b >= 0 and r["version"] == 1}
    assert 1 <= len(rewritten) <= 2 and all(second[b]["version"] == 0 for b in second if b >= 0 and b not in rewritten)
    assert feed([(902, kind[True], later + dt.timedelta(hours=3), "u6", "n", "film")]) == {2: []}
    third = waiting.read_manifest(spark, f"{base}/state", 2)
    assert sum(r["version"] == 0 for b, r in third.items() if b >= 0) >= len(first) - 6


def test_sequence_gaps_and_ordered_sources(spark):
    from reelwright.operators import gaps

    series = spark.createDataFrame([("a", "A", "one"), ("b", "B", "two"), ("c", None, "three"), ("d", "D", None)], "item_id string, name string, library string").withColumns(
        {"original_title": F.lit(None).cast("string"), "sort_name": F.lit("")})
    rows = [(s, 1, e, None) for s in "abcd" for e in (2, 5, 5, 9)] + [("d", 1, 3, 4), ("d", 2, 20240101, None), ("d", 0, 7, None), ("d", 3, None, None), ("d", 2, 0, None)]
    episodes = spark.createDataFrame(rows, "series_id string, season int, episode int, episode_end int")
    listed = spark.createDataFrame([("one", "a", 1, 4), ("one", "x", 0, 4), ("two", "b", 1, 8), (None, "d", 1, 1)], "library string, series_id string, season int, episode int")
    libraries = lambda *n: spark.createDataFrame([(x,) for x in n], "library string")
    found = gaps.missing_scan([("first", listed, libraries("one", None)), ("second", listed.where("false"), libraries("one", "two"))], episodes, series)
    got = sorted((r.series_id, r.season, r.first_episode, r.last_episode, r.source, r.series_name) for r in found.collect())
    assert got == [("a", 1, 4, 4, "first", "A")] + [("c", 1, x, y, "sequence", "Unknown Series") for x, y in ((1, 1), (3, 4), (6, 8))] + [
        ("d", 1, 1, 1, "sequence", "D"), ("d", 1, 6, 8, "sequence", "D"), ("d", 2, 1, 20240100, "sequence", "D")]
    assert gaps.missing_scan([], episodes.where("false"), series).count() == 0


def test_cut_lineage_is_read_by_column(spark):
    from reelwright.session import cut_lineage

    cut = cut_lineage(spark.range(5).selectExpr("id", "id * 2 AS twice"))
    assert sorted(r.twice for r in cut.collect()) == [0, 2, 4, 6, 8]
    assert "ReadSchema: struct<id:bigint>" in cut.select("id")._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_key_wait_in_many_files(spark, tmp_path):
    from reelwright.streaming import waiting

    base, schema = str(tmp_path), "ts timestamp, event_id bigint"
    spark.range(2000).selectExpr("timestamp_seconds(id) AS ts", "id AS event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(schema).parquet(f"{base}/in")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        waiting.run_waiting(stream, lambda b: b.select("ts", "event_id"), schema, lambda rows, clock: rows.withColumn(
            "settled", F.lit(False)), lambda rows, i: None, f"{base}/state", f"{base}/checkpoint", 0).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for f in os.listdir(f"{base}/state/waiting/0/bucket=0") if f.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(f"{base}/state/waiting/0/bucket=0").count() == 2000
