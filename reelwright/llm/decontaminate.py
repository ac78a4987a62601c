"""Benchmark decontamination: short test items found inside long documents.

An item is contained in a document if at least ``threshold`` of the item's different word shingles
occur in it. The search is a MinHash search partitioned by size:

* Items are dealt into classes by size, class c holding 2^c to 2^(c+1)-1 shingles. An item's sketch
  is its least hashed shingles, as many as an item of its class can miss, plus one. A document that
  contains the item misses fewer, so it holds at least one hash of the sketch: no leak is lost, and
  the sketch stays short because the item is, however long the document.
* Every shingle hash of every document is looked up among the sketches; a document smaller than
  the class allows is not a candidate.
* Candidates are verified on the shingles themselves, as text.

Jaccard-based MinHash bands would not do here: an item of 30 shingles in a document of 20,000 has a
Jaccard similarity of 0.0015, which no bounded number of bands finds.

The sketches and the items' shingles are broadcast only up to ``BROADCAST_ROWS`` rows, counted
first; beyond that Spark joins them by shuffle. The main path uses DataFrame functions only.

Words are runs of letters and digits, lower-cased. Texts with fewer words than the width have one
shingle, the whole sequence, so they match only texts with the same words; texts without words match
nothing. Null texts have no words. Rows are told apart by id and text: a repeated row gives one
result, a null id stays null. Equal items with different ids are all reported, repeated item rows
once. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.session import written

WIDTH = 5
THRESHOLD = 0.8
#: About 60 bytes each.
BROADCAST_ROWS = 200_000
KEY = ["key_id", "key_text"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _spans(of: Column, width: int, make) -> Column:
    """``make`` over the first place of each shingle; one place if there are fewer words; none without words."""
    n = F.size(of)
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), make)
    return F.when(n == 0, F.slice(many, 1, 0)).otherwise(many)


def shingle_hashes(of: Column, width: int) -> Column:
    """64-bit hashes of the shingles of a word array, in order."""
    return _spans(of, width, lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(width)]))


def shingle_texts(of: Column, width: int) -> Column:
    """The different shingles of a word array, as text."""
    return F.array_distinct(_spans(of, width, lambda i: F.array_join(F.slice(of, i + 1, width), " ")))


def _key(id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(KEY[0]),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col)).alias(KEY[1]),
    ]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, id_col: str = "item_id",
                  text_col: str = "text") -> DataFrame:
    """(item_id, item, n, need, kept, shingles, hashes): a hash of the words, size, shared shingles asked for, length of the sketch."""
    cut = written(items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).distinct(), "items")
    sized = cut.where(F.size("words") > 0).select("item_id", F.xxhash64("words").alias("item"), shingle_texts(F.col("words"), width).alias("shingles"),
                       F.sort_array(F.array_distinct(shingle_hashes(F.col("words"), width))).alias("hashes"))
    n = F.size("shingles")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1  # of the class
    need = F.ceil(n * F.lit(threshold) - F.lit(1e-9))
    kept = (F.floor(largest * F.lit(1 - threshold) + F.lit(1e-9)) + 1).cast("int")
    return sized.select("item_id", "item", n.alias("n"), need.alias("need"), kept.alias("kept"), "shingles",
                        "hashes")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key_id, key_text, doc_id, item_id, n_shingles, n_shared, containment): documents with the items they contain."""
    sized = item_shingles(items, width, threshold)
    # One row per different shingle of an item; the sketch is a part of them.
    totals = sized.agg(F.sum("n"), F.sum(F.least("kept", "n"))).first()
    n_shingles, n_sketch = (x or 0 for x in totals)
    sketch = sized.select("need", F.explode(F.slice("hashes", F.lit(1), F.col("kept"))).alias("hash"))
    sketch = sketch.groupBy("hash").agg(F.min("need").alias("need"))
    # explode_outer: an inner explode would add a filter that computes the array a second time, from the text.
    cut = docs.select(*_key(id_col, text_col), words(F.col(text_col)).alias("words"))
    hashed = cut.select(*KEY, F.size("words").alias("n_words"), shingle_hashes(F.col("words"), width).alias("hashes"))
    looked_up = hashed.select(*KEY, "n_words", F.explode_outer("hashes").alias("hash")).join(_small(sketch, n_sketch), "hash")
    large_enough = F.greatest(F.col("n_words") - (width - 1), F.lit(1)) >= F.col("need")
    candidates = looked_up.where(large_enough).select(*KEY).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_key(id_col, text_col))
    # The words are a column of their own: inside a lambda they would be cut again for each shingle.
    chosen = texts.join(candidates, KEY, "left_semi").select(*KEY, "doc_id", words(F.col("text")).alias("words"))
    inside = chosen.select(*KEY, "doc_id", F.explode_outer(shingle_texts(F.col("words"), width)).alias("shingle"))
    of_items = sized.select("item_id", "item", "n", "need", F.explode("shingles").alias("shingle"))
    shared = inside.join(_small(of_items, n_shingles), "shingle")
    # A repeated row has the same key: its shingles count once.
    once = shared.groupBy(*KEY, "item_id", "item", "shingle").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("need").alias("need"))
    counted = once.groupBy(*KEY, "item_id", "item").agg(
        F.first("doc_id").alias("doc_id"), F.first("n").alias("n_shingles"), F.first("need").alias("need"),
        F.count(F.lit(1)).cast("int").alias("n_shared"))
    return counted.where("n_shared >= need").select(
        *KEY, "doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment), one row per leak."""
    return leaks(docs, items, width, threshold).drop(*KEY)


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item."""
    found = leaks(docs, items, width, threshold).select(*KEY).distinct()
    keyed = docs.select("*", *_key("doc_id", "text"))
    return keyed.join(found, KEY, "left_anti").drop(*KEY)


#: DuckDB: every leak among ``documents``.
LEAKS_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM d WHERE len(w) > 0),
bs AS (
  SELECT DISTINCT item_id, w, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM b WHERE len(w) > 0),
size AS (SELECT item_id, w, count(*) AS n FROM bs GROUP BY item_id, w)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / n AS containment
FROM ds JOIN bs USING (s) JOIN size USING (item_id, w)
GROUP BY doc_id, text, item_id, w, n
HAVING count(*) >= 0.8 * n - 1e-9
"""
