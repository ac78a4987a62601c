"""The inventory's log of several runs: what a run reads and writes, and runs that break off."""

import re
import uuid

import pytest

from reelwright.session import shared_folder
from reelwright.sources.inventory_log import InventoryLog

SCAN = "path string, size long, mtime double, side_data array<struct<dv_profile:int>>"


@pytest.fixture
def log(spark):
    name = f"inventory_{uuid.uuid4().hex}"
    return InventoryLog(spark, name, shared_folder(spark, name), 4).create()


def scan(spark, *files):
    return spark.createDataFrame([(p, size, 1.0, [(profile,)] if profile else []) for p, size, profile in files], SCAN)


def test_only_the_scan_is_shuffled(spark, log):
    log.record(scan(spark, *[(f"/m/{i}", i, None) for i in range(100)]), "2024-01-01")
    changes = log.changes(scan(spark, ("/m/1", 1, None)), "2024-01-02")
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, plan
    assert "Bucketed: true" in plan


def test_a_run_writes_what_changed(spark, log):
    files = [(f"/m/{i}", i, None) for i in range(100)]
    log.record(scan(spark, *files), "2024-01-01")
    log.record(scan(spark, *files), "2024-01-02")
    assert spark.table(log.name).count() == 100
    log.record(scan(spark, *files[1:99], ("/m/99", 7, 5)), "2024-01-03")
    assert spark.table(log.name).count() == 102
    got = [tuple(r)[1:] for r in log.last_runs().collect()]
    assert got == [(99, 1, 0, 1, 1, 1), (100, 0, 0, 0, 0, 0), (100, 100, 100, 0, 0, 0)]
    assert {str(r.last_checked) for r in log.as_of().collect()} == {"2024-01-03 00:00:00"}
    assert [r.path for r in log.removed().collect()] == ["/m/0"]


def test_a_run_that_broke_off_is_not_read(spark, log):
    log.record(scan(spark, ("/m/a", 1, 5), ("/m/b", 2, None)), "2024-01-01")
    second = scan(spark, ("/m/a", 3, None))
    log._append(log.changes(second, "2024-01-02"), "2024-01-02")  # and no commit
    assert {(r.path, r.size) for r in log.as_of().collect()} == {("/m/a", 1), ("/m/b", 2)}
    assert log.removed().count() == log.resolved().count() == 0
    log.record(second, "2024-01-02")
    assert [(r.path, r.size, r.status) for r in log.as_of().collect()] == [("/m/a", 3, "ok")]
    assert [r.path for r in log.resolved().collect()] == ["/m/a"]
    assert log.history().count() == 3 and log.history().where("valid_to IS NULL").count() == 1


def test_marks_failures_and_returns(spark, log):
    log.record(scan(spark, ("/m/a", 1, 5), ("/m/b", 2, 5)), "2024-01-01")
    marks = spark.createDataFrame([("/m/a", "ignored"), ("/m/a", "bogus"), ("/m/none", "ok")], "path string, status string")
    log.mark(marks, "2024-01-02")
    log.fail(spark.createDataFrame([("/m/b",)] * 3, "path string"), "2024-01-03")
    assert {(r.path, r.status, r.fail_count) for r in log.as_of().collect()} == {("/m/a", "ignored", 0), ("/m/b", "failed", 3)}
    log.record(scan(spark, ("/m/a", 9, 5)), "2024-01-04")
    log.record(scan(spark, ("/m/a", 9, 5), ("/m/b", 2, 5)), "2024-01-05")
    now = {r.path: (r.status, str(r.first_seen)[:10]) for r in log.as_of().collect()}
    assert now == {"/m/a": ("ignored", "2024-01-01"), "/m/b": ("needs_rebuild", "2024-01-05")}
    assert [r.problematic for r in log.last_runs().collect()] == [1, 0, 2]
    assert {(r.path, r.flag) for r in log.first_seen_in("2024-01-05").collect()} == {("/m/b", "PROBLEMATIC")}


def test_an_empty_log_and_an_empty_scan(spark, log):
    assert log.as_of().count() == log.history().count() == log.last_runs().count() == 0
    log.record(spark.createDataFrame([], SCAN), "2024-01-01")
    assert [tuple(r)[1:] for r in log.last_runs().collect()] == [(0, 0, 0, 0, 0, 0)]
    again = InventoryLog(spark, f"{log.name}_again", log.path, 4).create()
    assert again.last_runs().count() == 1
