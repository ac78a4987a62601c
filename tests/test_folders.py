"""Libraries by folder rules: literal cases, and a brute-force comparison."""

import random

from reelwright.operators.folders import with_library

RULES = "priority int, folders string, library string"


def libraries(spark, paths, rules):
    items = spark.createDataFrame(list(enumerate(paths)), "item_id int, path string")
    found = with_library(items, spark.createDataFrame(rules, RULES)).collect()
    assert len(found) == len(paths)
    return [r.guessed_library for r in sorted(found, key=lambda r: r.item_id)]


def test_rules_name_whole_folders(spark):
    rules = [(2, "/Movies/4K/", "A"), (1, "4K", "B"), (3, "/Series/", "C"), (3, "Series/", "Aa"), (0, None, "x"), (0, "/", "x"),
             (None, "/Series/", "x"), (0, "/Series/", None)]
    paths = ["/Movies/4K/a.mkv", "/Movies/4K", "Movies/4K/a.mkv", "/x/Series/4Kk/a", "/x/Series", "", None, "a.mkv", "/a\nb/Series/a"]
    assert libraries(spark, paths, rules) == ["B", "Other", "B", "Aa", "Other", "Other", "Other", "Other", "Aa"]


def test_no_rules_and_no_items(spark):
    assert libraries(spark, ["/a/b/c", None], []) == ["Other", "Other"]
    assert libraries(spark, [], [(1, "a", "A")]) == []


def test_like_contains(spark):
    rng = random.Random(3)
    rules = sorted({(rng.randrange(20), "/" + "/".join(rng.choices("abcd", k=rng.randint(1, 4))) + "/", f"L{i % 9}") for i in range(60)})
    paths = ["/" + "/".join(rng.choices("abcde", k=rng.randint(1, 9))) for _ in range(400)] + ["/a/b/c/d/hot"] * 400
    expected = [next((library for _, folders, library in sorted(rules, key=lambda r: (r[0], r[2])) if folders in path), "Other")
                for path in paths]
    assert libraries(spark, paths, rules) == expected


def test_rules_meet_folders_by_equality(spark):
    items = spark.createDataFrame([("/a/b/c",)], "path string")
    plan = with_library(items, spark.createDataFrame([(1, "a", "A")], RULES))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan
