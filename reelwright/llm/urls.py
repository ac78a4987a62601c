"""URL filter rules by a sort-merge range join on reversed hosts.

A host is written back to front by labels with a dot after each (``www.example.com`` becomes
``com.example.www.``). The hosts that a rule fits are then those that begin with the rule's key, an
interval in the order of keys, and intervals of different rules are nested or apart. URLs are dealt
into ranges of the key; a rule goes to each range that its interval meets, so a range starts with
the rules that are open at its first key. Within a range, URLs and rules are sorted together and
swept once: a stack holds the rules whose interval is open, the innermost on top, and a URL looks
for its longest rule among them by its path.

A rule fits a URL if the URL's host is the rule's host or lies below it, and the URL's path starts
with the rule's path. The longest host and path together win; of equal ones the longer host, and of
the same rule given twice with different verdicts, block.

Ranges are dealt by key and row, so one host may fill many ranges. What goes to every range is only
the rules around its first and last key. The number of ranges is that of the shuffle partitions,
and a table with one row per range is broadcast.

Defined results: a null URL, or one without ``://``, has empty host and path and fits no rule. Rules
without a host fit nothing; a null path is empty. Repeated rows each get their result. An empty
table of URLs or of rules is fine. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"
#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels back to front, a dot after each; empty for an empty host."""
    back = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.when(host == "", F.lit("")).otherwise(F.concat(back, F.lit(".")))


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


class Open:
    """Rules of one host whose interval is open: path to verdict, and the lengths of the paths."""

    def __init__(self, key: str):
        self.key, self.paths, self.sizes = key, {}, []

    def add(self, host: str, path: str, verdict: str) -> None:
        if path not in self.paths or verdict == "block":
            self.paths[path] = (host, path, verdict)
        self.sizes = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str) -> tuple[str, str, str] | None:
        for size in self.sizes:
            if size <= len(path) and (found := self.paths.get(path[:size])) is not None:
                return found
        return None


def best_rule(stack: list[Open], path: str) -> tuple[str, str, str] | None:
    found = [r for o in stack if (r := o.longest(path)) is not None]
    return max(found, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)


SWEPT = "id long, host string, path string, rule string, verdict string"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, key, is_url, id, host, path, verdict) in order of range, key, is_url."""
    stack: list[Open] = []
    at = None
    types = [pa.int64(), *[pa.string()] * 4]
    for batch in batches:
        rows = []
        for here, key, is_url, i, host, path, verdict in zip(*[c.to_pylist() for c in batch.columns]):
            if here != at:
                at, stack = here, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if is_url:
                rule = best_rule(stack, path)
                rows.append((i, host, path, rule and rule[0] + rule[1], rule[2] if rule else DEFAULT))
                continue
            if not stack or stack[-1].key != key:
                stack.append(Open(key))
            stack[-1].add(host, path, verdict)
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         ["id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rules`` has verdict, host, path."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    keyed = urls.select(host_key(F.col("host")).alias("key"), "id", "host", "path",
                        F.monotonically_increasing_id().alias("row"))
    ranged = keyed.repartitionByRange("key", "row").drop("row").withColumn("range", F.spark_partition_id())
    dealt = written(ranged, "urls")
    ends = dealt.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    usable = rules.where("host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).withColumn("rule_key", host_key(F.col("host")))
    # The interval of a rule meets a range if it holds the first key or starts inside the range.
    meets = F.startswith("first", "rule_key") | F.col("rule_key").between(F.col("first"), F.col("last"))
    placed = usable.join(F.broadcast(ends), meets).select(
        "range", F.col("rule_key").alias("key"), F.lit(0).alias("is_url"), F.lit(None).cast("long").alias("id"),
        "host", "path", "verdict")
    rows = dealt.select("range", "key", F.lit(1).alias("is_url"), "id", "host", "path",
                        F.lit(None).cast("string").alias("verdict")).unionByName(placed)
    swept = rows.repartition("range").sortWithinPartitions("range", "key", "is_url").mapInArrow(_sweep, SWEPT)
    return swept.withColumnRenamed("id", id_col)


#: DuckDB: the verdict on every row of ``pages`` under RULES.
JUDGE_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES %s),
m AS (
  SELECT s.*, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM s LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""" % ", ".join(str(r) for r in RULES)
