"""Nested documents: valid JSON in order, and the rows read back."""

import glob
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelwright.sources.documents import Level, read_document, read_head, write_document

SHOWS = [Level("shows", ["rank", "show"], ["show", "imdb"]), Level("seasons", ["season"], ["season"]), Level("episodes", ["episode"], ["episode", "title"])]
SCHEMAS = [("shows", "show string, imdb string"), ("seasons", "season int"), ("episodes", "episode int, title string")]
ROW = "rank int, show string, imdb string, season int, episode int, title string"


def document(path):
    files = sorted(glob.glob(f"{path}/part-*"), key=lambda f: int(re.search(r"part-(\d+)", f).group(1)))
    return json.loads("".join(open(f, encoding="utf-8").read() for f in files))


def test_nested_document(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for show in range(20):
        for _ in range(900 if show == 7 else rng.randint(1, 12)):
            # repeated rows, ties, nulls, and texts that look like the document's own lines
            rows.append((show % 4, f'S"{show}', None if show % 3 else f"tt{show}", rng.choice([None, 0, 1, 2]), rng.choice([None, 1, 2, 3]),
                         rng.choice([None, "", 'a "seasons":[', '"episodes":[', "]}", ",{", "line\nbreak ", "č"])))
    rows += [rows[0]] * 2500
    frame = spark.createDataFrame(rows, ROW).repartition(7)
    head = spark.createDataFrame([(len(rows), None)], "total int, note string")
    path = str(tmp_path / "doc")
    write_document(head, frame, SHOWS, path)

    written = document(path)
    assert (written["total"], written["note"]) == (len(rows), None)
    flat = [(s["show"], s["imdb"], q["season"], e["episode"], e["title"]) for s in written["shows"] for q in s["seasons"] for e in q["episodes"]]
    assert Counter(flat) == Counter((r[1], r[2], r[3], r[4], r[5]) for r in rows)
    assert [s["show"] for s in written["shows"]] == [s for _, s in sorted({(r[0], r[1]) for r in rows})]
    first = lambda value: -1 if value is None else value
    for show in written["shows"]:
        seasons = [first(q["season"]) for q in show["seasons"]]
        assert seasons == sorted(set(seasons))
        for season in show["seasons"]:
            episodes = [first(e["episode"]) for e in season["episodes"]]
            assert episodes == sorted(episodes)

    back = read_document(spark, path, "total int, note string", SCHEMAS)
    got = back.select("head.total", "shows.show", "shows.imdb", "seasons.season", "episodes.episode", "episodes.title").collect()
    assert Counter(tuple(r) for r in got) == Counter((len(rows), *f) for f in flat)
    assert [tuple(r) for r in read_head(spark, path, "total int, note string", "shows").collect()] == [(len(rows), None)]


def test_blocks_carry_what_was_opened(spark, tmp_path):
    rows = [(1, "long", "tt1", 1, n, "x" * 50) for n in range(3000)] + [(2, "next", None, 1, 1, "y")]
    path = str(tmp_path / "doc")
    write_document(spark.createDataFrame([(1,)], "total int"), spark.createDataFrame(rows, ROW).coalesce(1), SHOWS, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = read_document(spark, path, "total int", SCHEMAS).select("shows.show", F.col("episodes.episode").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.show, r.n) for r in back) == sorted((r[1], r[4]) for r in rows)


def test_empty_flat_and_existing(spark, tmp_path):
    level = [Level("items", ["id"], ["id", "genres"])]
    head = spark.createDataFrame([(0,)], "total int")
    write_document(head, spark.createDataFrame([], "id int, genres array<string>"), level, str(tmp_path / "none"))
    assert document(tmp_path / "none") == {"total": 0, "items": []}
    assert read_document(spark, str(tmp_path / "none"), "total int", [("items", "id int, genres array<string>")]).count() == 0
    assert read_head(spark, str(tmp_path / "none"), "total int", "items").collect()[0].total == 0
    write_document(head, spark.createDataFrame([(2, ["b"]), (1, None)], "id int, genres array<string>"), level, str(tmp_path / "two"))
    assert document(tmp_path / "two") == {"total": 0, "items": [{"id": 1, "genres": None}, {"id": 2, "genres": ["b"]}]}
    with pytest.raises(Exception, match="(?i)exist"):
        write_document(head, spark.createDataFrame([], "id int, genres array<string>"), level, str(tmp_path / "two"))
