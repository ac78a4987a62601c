"""Queries of the inventory family and of the catalogue scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelwright.operators import inventory as I
from reelwright.session import shared_folder
from reelwright.sources import catalogue as C
from reelwright.sources.inventory_log import InventoryLog
from verification.bridge import Bridge
from verification.registry import fragment, query

NOW = "2023-07-01 00:00:00"
fragment("o_diff", """SELECT *, CASE WHEN d % 5 = 0 THEN 'deleted' WHEN d % 7 = 0 THEN 'new' WHEN d % 11 = 0 OR d % 13 = 0 THEN 'changed' ELSE 'unchanged' END AS change
FROM b_inventory WHERE d % 5 <> 0 OR d % 7 <> 0""")
fragment("o_next", """SELECT path, cur_size AS size, change, dv_profile, CASE WHEN change = 'unchanged' THEN prev_status WHEN change = 'changed' AND prev_status IN ('ignored', 'converted', 'failed') THEN prev_status
WHEN dv_profile = 5 THEN 'needs_rebuild' ELSE 'ok' END AS status, CASE WHEN change = 'unchanged' THEN prev_first_seen WHEN change = 'changed' THEN coalesce(prev_first_seen, '2023-07-01') ELSE '2023-07-01' END AS first_seen,
CASE WHEN change = 'new' THEN 0 ELSE prev_fail_count END AS fail_count, prev_status FROM o_diff WHERE change <> 'deleted'""")


def _next(b: Bridge, full: bool = False):
    return I.inventory_upsert(b.inventory_state, b.inventory_scan, NOW, full)


@query("inventory_diff", "SELECT path, change FROM o_diff")
def _(b: Bridge):
    return I.inventory_diff(b.inventory_state, b.inventory_scan).select("path", "change")


@query("inventory_diff_full", "SELECT CASE change WHEN 'unchanged' THEN 'changed' ELSE change END AS change, count(*) AS n FROM o_diff GROUP BY 1")
def _(b: Bridge):
    return I.inventory_diff(b.inventory_state, b.inventory_scan, full=True).groupBy("change").agg(F.count("*").alias("n"))


@query("derive_status", "SELECT path, CASE WHEN prev_status IN ('ignored', 'converted', 'failed') THEN prev_status WHEN dv_profile = 5 THEN 'needs_rebuild' ELSE 'ok' END AS status FROM b_inventory WHERE d % 7 <> 0")
def _(b: Bridge):
    return b.inventory_state.select("path", I.derive_status(F.col("dv_profile"), F.col("status")).alias("status"))


@query("inventory_upsert", "SELECT path, size, dv_profile, status, first_seen, fail_count, change FROM o_next")
def _(b: Bridge):
    return _next(b).select("path", "size", "dv_profile", "status", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), "fail_count", "change")


@query("inventory_archive", """SELECT path, prev_size AS size, dv_profile IS NOT NULL AS is_dv, coalesce(dv_profile = 5, false) AS problematic, prev_status AS last_status, prev_first_seen AS first_seen
FROM o_diff WHERE change = 'deleted'""")
def _(b: Bridge):
    rows = I.inventory_archive(b.inventory_state, b.inventory_scan, NOW).withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd"))
    return I.removed_history(rows).drop("removed_at")


@query("inventory_run_log", """SELECT count(*) FILTER (change <> 'deleted') AS total, count(*) FILTER (change IN ('new', 'changed')) AS probed, count(*) FILTER (change = 'new') AS new,
count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'deleted') AS deleted, (SELECT count(*) FROM o_next WHERE dv_profile = 5 AND status = 'needs_rebuild') AS problematic FROM o_diff""")
def _(b: Bridge):
    return I.last_runs(I.inventory_run_log(b.inventory_state, _next(b), b.inventory_scan, NOW)).drop("ts")


@query("inventory_reports", "SELECT status, count(*) AS n_files, count(dv_profile) AS n_dv FROM o_next GROUP BY 1")
def _(b: Bridge):
    return I.status_counts(_next(b))


@query("rebuild_pile", "SELECT path, dv_profile FROM o_next WHERE dv_profile = 5 AND status = 'needs_rebuild'")
def _(b: Bridge):
    return I.rebuild_pile(_next(b))


@query("first_seen_last_run", "SELECT path, CASE WHEN dv_profile = 5 THEN 'PROBLEMATIC' WHEN dv_profile IS NOT NULL THEN 'DV-ok' ELSE '' END AS flag FROM o_next WHERE first_seen = '2023-07-01'")
def _(b: Bridge):
    return I.first_seen_in(_next(b), NOW)


@query("resolved_files", "SELECT path FROM o_next WHERE change = 'changed' AND prev_status = 'needs_rebuild' AND coalesce(dv_profile <> 5, true)")
def _(b: Bridge):
    return I.resolved(b.inventory_state, _next(b))


@query("good_count", "SELECT count(*) AS n_good FROM o_next WHERE status IN ('ok', 'converted')")
def _(b: Bridge):
    return I.good_count(_next(b))


@query("record_failure", """SELECT path, prev_fail_count + CASE WHEN d % 3 = 0 THEN 1 WHEN d % 3 = 1 THEN 2 ELSE 0 END AS fail_count, CASE WHEN d % 3 <> 2 AND prev_fail_count + CASE WHEN d % 3 = 0 THEN 1 ELSE 2 END >= 3
THEN 'failed' ELSE prev_status END AS status FROM b_inventory WHERE d % 7 <> 0""")
def _(b: Bridge):
    number = F.regexp_extract("path", r"file (\d+)", 1).cast("bigint")
    failures = b.inventory_state.select("path", F.explode(F.when(number % 3 == 0, F.array(F.lit(1))).when(number % 3 == 1, F.array(F.lit(1), F.lit(2)))).alias("_"))
    return I.record_failure(b.inventory_state, failures).select("path", "fail_count", "status")


@query("mark_status", "SELECT path, CASE WHEN d % 4 = 0 THEN 'ignored' ELSE prev_status END AS status FROM b_inventory WHERE d % 7 <> 0")
def _(b: Bridge):
    number = F.regexp_extract("path", r"file (\d+)", 1).cast("bigint")
    marks = b.inventory_scan.unionByName(b.inventory_state, True).where((number % 4 == 0) | (number % 4 == 1)).select(
        "path", F.when(number % 4 == 0, "ignored").otherwise("bogus").alias("status"))
    return I.mark_status(b.inventory_state, marks).select("path", "status")


# ------------------------------------------------------------------ log of several runs
# Three scans with a round of marks between the first two; the third finds some files repaired and others back again.
RUN_TIMES = ("2023-05-01 00:00:00", "2023-06-01 00:00:00", "2023-07-01 00:00:00")
MARK_TIME = "2023-05-15 00:00:00"
_SCANS = (
    ("d % 7 <> 0", "prev_size", "prev_mtime", "dv_profile"),
    ("d % 5 <> 0", "cur_size", "cur_mtime", "dv_profile"),
    ("(d % 3 <> 0 OR d % 2 = 0)", "cur_size + CASE WHEN d % 17 = 0 OR d % 18 = 0 THEN 5 ELSE 0 END", "cur_mtime", "CASE WHEN d % 18 <> 0 THEN dv_profile END"),
)


def _status(profile: str, marked: str = "false") -> str:
    return f"CASE WHEN {marked} THEN 'ignored' WHEN {profile} = 5 THEN 'needs_rebuild' ELSE 'ok' END"


fragment("o_runs", f"""SELECT *, d % 7 <> 0 AS p1, d % 5 <> 0 AS p2, d % 3 <> 0 OR d % 2 = 0 AS p3, d % 11 = 0 OR d % 13 = 0 AS c2, d % 17 = 0 OR d % 18 = 0 AS c3, d % 7 <> 0 AND d % 23 = 0 AS marked,
{_SCANS[2][1]} AS size3, CASE WHEN d % 18 <> 0 THEN dv_profile END AS profile3 FROM b_inventory""")
fragment("o_log", f"""SELECT path, prev_size AS size, dv_profile, {_status('dv_profile')} AS status, 'new' AS change, TIMESTAMP '{RUN_TIMES[0]}' AS run_at, TIMESTAMP '{RUN_TIMES[0]}' AS first_seen,
NULL AS old_status, NULL::int AS old_profile, NULL::bigint AS old_size FROM o_runs WHERE p1
UNION ALL SELECT path, prev_size, dv_profile, 'ignored', 'marked', TIMESTAMP '{MARK_TIME}', TIMESTAMP '{RUN_TIMES[0]}', {_status('dv_profile')}, dv_profile, prev_size FROM o_runs WHERE marked
UNION ALL SELECT path, cur_size, dv_profile, {_status('dv_profile', 'marked')}, CASE WHEN p1 THEN 'changed' ELSE 'new' END, TIMESTAMP '{RUN_TIMES[1]}', CASE WHEN p1 THEN TIMESTAMP '{RUN_TIMES[0]}' ELSE TIMESTAMP '{RUN_TIMES[1]}' END,
CASE WHEN p1 THEN {_status('dv_profile', 'marked')} END, CASE WHEN p1 THEN dv_profile END, CASE WHEN p1 THEN prev_size END FROM o_runs WHERE p2 AND (NOT p1 OR c2)
UNION ALL SELECT path, NULL, NULL, NULL, 'deleted', TIMESTAMP '{RUN_TIMES[1]}', TIMESTAMP '{RUN_TIMES[0]}', {_status('dv_profile', 'marked')}, dv_profile, prev_size FROM o_runs WHERE p1 AND NOT p2
UNION ALL SELECT path, size3, profile3, {_status('profile3', 'p2 AND marked')}, CASE WHEN p2 THEN 'changed' ELSE 'new' END, TIMESTAMP '{RUN_TIMES[2]}',
CASE WHEN p2 AND p1 THEN TIMESTAMP '{RUN_TIMES[0]}' WHEN p2 THEN TIMESTAMP '{RUN_TIMES[1]}' ELSE TIMESTAMP '{RUN_TIMES[2]}' END,
CASE WHEN p2 THEN {_status('dv_profile', 'marked')} END, CASE WHEN p2 THEN dv_profile END, CASE WHEN p2 THEN cur_size END FROM o_runs WHERE p3 AND (NOT p2 OR c3)
UNION ALL SELECT path, NULL, NULL, NULL, 'deleted', TIMESTAMP '{RUN_TIMES[2]}', CASE WHEN p1 THEN TIMESTAMP '{RUN_TIMES[0]}' ELSE TIMESTAMP '{RUN_TIMES[1]}' END,
{_status('dv_profile', 'marked')}, dv_profile, cur_size FROM o_runs WHERE p2 AND NOT p3""")
fragment("o_asof", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY run_at DESC) AS nth FROM o_log WHERE run_at <= TIMESTAMP '{RUN_TIMES[1]}') WHERE nth = 1 AND change <> 'deleted'""")


def run_scan(b: Bridge, n: int):
    """The files that the n-th run finds."""
    there, size, mtime, profile = _SCANS[n]
    side = f"CASE WHEN {profile} IS NULL THEN array() ELSE array(named_struct('dv_profile', cast({profile} as int))) END"
    return b._inventory.where(there).selectExpr("path", f"{size} AS size", f"{mtime} AS mtime", f"{side} AS side_data")


def _log(b: Bridge) -> InventoryLog:
    name = f"inventory_{uuid.uuid4().hex}"
    log = InventoryLog(b.spark, name, shared_folder(b.spark, name), 8).create()
    log.record(run_scan(b, 0), RUN_TIMES[0])
    log.mark(b._inventory.where("d % 23 = 0").selectExpr("path", "'ignored' AS status"), MARK_TIME)
    for n in (1, 2):
        log.record(run_scan(b, n), RUN_TIMES[n])
    return log


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


@query("inventory_history", """SELECT path, size, dv_profile, status, change, strftime(first_seen, '%Y-%m-%d') AS first_seen, strftime(run_at, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to
FROM (SELECT *, lead(run_at) OVER (PARTITION BY path ORDER BY run_at) AS valid_to FROM o_log) WHERE change <> 'deleted'""")
def _(b: Bridge):
    return _log(b).history().select("path", "size", "dv_profile", "status", "change", _day("first_seen"), _day("valid_from"), _day("valid_to"))


@query("inventory_as_of", f"SELECT path, size, dv_profile, status, strftime(first_seen, '%Y-%m-%d') AS first_seen, '{RUN_TIMES[1][:10]}' AS last_checked FROM o_asof")
def _(b: Bridge):
    return _log(b).as_of(RUN_TIMES[1]).select("path", "size", "dv_profile", "status", _day("first_seen"), _day("last_checked"))


@query("inventory_removed", """SELECT path, old_size AS size, old_profile IS NOT NULL AS is_dv, coalesce(old_profile = 5, false) AS problematic, old_status AS last_status, strftime(first_seen, '%Y-%m-%d') AS first_seen,
strftime(run_at, '%Y-%m-%d') AS removed_at FROM o_log WHERE change = 'deleted'""")
def _(b: Bridge):
    return _log(b).removed().select("path", "size", "is_dv", "problematic", "last_status", _day("first_seen"), _day("removed_at"))


@query("inventory_resolved", "SELECT path, strftime(run_at, '%Y-%m-%d') AS resolved_at FROM o_log WHERE change IN ('new', 'changed') AND old_status = 'needs_rebuild' AND coalesce(dv_profile <> 5, true)")
def _(b: Bridge):
    return _log(b).resolved().select("path", _day("resolved_at"))


@query("inventory_runs", """SELECT strftime(r.run_at, '%Y-%m-%d') AS run_at, (SELECT sum(CASE change WHEN 'new' THEN 1 WHEN 'deleted' THEN -1 ELSE 0 END)::bigint FROM o_log l WHERE l.run_at <= r.run_at) AS total,
new + changed AS probed, new, changed, deleted, (SELECT count(*) FROM (SELECT dv_profile, status, row_number() OVER (PARTITION BY path ORDER BY run_at DESC) AS nth FROM o_log l WHERE l.run_at <= r.run_at) WHERE nth = 1 AND dv_profile = 5 AND status = 'needs_rebuild') AS problematic
FROM (SELECT run_at, count(*) FILTER (change = 'new') AS new, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'deleted') AS deleted FROM o_log WHERE change <> 'marked' GROUP BY 1) r""")
def _(b: Bridge):
    return _log(b).last_runs().select(_day("run_at"), "total", "probed", "new", "changed", "deleted", "problematic")


# ---------------------------------------------------------------------- catalogue scans
@query("scan_items", "SELECT item_id, name, path, library FROM b_items WHERE type = 'Movie' AND library IN ('Lib 1', 'Lib 2')")
def _(b: Bridge):
    return C.scan_items(b.items, ["Movie"], ["Lib 1", "Lib 2"], ["item_id", "name", "path"])


@query("scan_by_ids", """SELECT i.item_id, i.path, l.l_linestatus AS asked_by FROM b_items i JOIN (SELECT cast(l_partkey as varchar) AS item_id, min(l_linestatus) AS l_linestatus FROM lineitem WHERE l_quantity > 48 GROUP BY 1) l USING (item_id)""")
def _(b: Bridge):
    ids = b.table("lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").cast("string").alias("item_id")).agg(F.min("l_linestatus").alias("asked_by"))
    return C.scan_by_ids(b.items, ids).select("item_id", "path", "asked_by")


def _libraries(b: Bridge):
    return b.items.groupBy(F.col("library").alias("name")).agg(F.min("item_id").alias("library_id"))


@query("resolve_libraries", """SELECT n.name, l.library_id FROM (SELECT DISTINCT CASE WHEN c_custkey % 6 < 4 THEN 'LIB ' || (c_custkey % 6) ELSE 'Nowhere ' || (c_custkey % 6) END AS name FROM customer) n
LEFT JOIN (SELECT library AS name, min(item_id) AS library_id FROM b_items GROUP BY 1) l ON lower(l.name) = lower(n.name)""")
def _(b: Bridge):
    k = F.col("c_custkey") % 6
    names = b.table("customer").select(F.when(k < 4, F.concat(F.lit("LIB "), k.cast("string"))).otherwise(F.concat(F.lit("Nowhere "), k.cast("string"))).alias("name")).distinct()
    return C.resolve_libraries(_libraries(b), names)


@query("resolve_user", """SELECT 'named' AS asked, user_id FROM b_users WHERE lower(user_name) = 'supplier#000000007' UNION ALL SELECT 'unknown', arg_min(user_id, user_id::int) FROM b_users""")
def _(b: Bridge):
    order = [F.col("user_id").cast("int")]
    named = C.resolve_user(b.users, "SUPPLIER#000000007", order).select(F.lit("named").alias("asked"), "user_id")
    return named.unionByName(C.resolve_user(b.users, "nobody", order).select(F.lit("unknown").alias("asked"), "user_id"))


@query("probe_library_content", """SELECT library, count(*) FILTER (type = 'Movie') AS n_movies, count(*) FILTER (type = 'Series') AS n_series, bool_or(type = 'Movie') AS in_movie_pass, bool_or(type = 'Series') AS in_series_pass
FROM (SELECT library, type FROM b_items UNION ALL SELECT library, type FROM b_series) GROUP BY 1""")
def _(b: Bridge):
    return C.probe_library_content(b.items.select("library", "type").unionByName(b.series.select("library", "type")))


@query("scan_paths", "SELECT path FROM b_items")
def _(b: Bridge):
    return C.scan_paths(b.items.select("type", "path").unionByName(b.series.select("type", "path")))


@query("scan_children", "SELECT i.item_id, i.series_id, i.episode, s.name AS parent_name FROM b_items i JOIN b_series s ON s.item_id = i.series_id WHERE i.season = 1")
def _(b: Bridge):
    return C.scan_children(b.items.where("type = 'Episode'"), b.series, 1).select("item_id", "series_id", "episode", "parent_name")


@query("scan_seasons", "SELECT series_id, season, count(*) AS n_episodes FROM b_items WHERE series_id IS NOT NULL GROUP BY ALL")
def _(b: Bridge):
    return C.series_seasons(b.items)


@query("scan_users", "SELECT user_id, user_name FROM b_users")
def _(b: Bridge):
    return C.scan_users(b.users)
