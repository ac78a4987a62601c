"""Nested JSON documents of any size: written line by line in order, read back as rows.

A document is an object with a head and one list; the elements of a list may hold a list in turn. Each line of the
files is the opening of an object up to its list, a whole innermost element, or a closing, so no task holds a list.
The files, joined by number, are the JSON document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelwright.operators.grouping import spread_join
from reelwright.session import written

OPEN, WITHIN, CLOSE = 0, 1, 2
KEEP_NULLS = {"ignoreNullFields": "false"}


@dataclass(frozen=True)
class Level:
    """A list: its name in the parent, the columns that order and tell apart its elements there, their fields."""

    name: str
    keys: Sequence[str]
    fields: Sequence[str]


def _opening(fields: Sequence[Column | str], name: str) -> Column:
    """The object of the fields, open at the list ``name``; without fields, the list alone."""
    start = f'"{name}":['
    if not fields:
        return F.lit("{" + start)
    text = F.to_json(F.struct(*fields), KEEP_NULLS)
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("," + start))


def document_lines(head: DataFrame, rows: DataFrame, levels: Sequence[Level]) -> DataFrame:
    """The lines of the document in order, as ``value``.

    ``head`` is one row, the fields of the document. ``rows`` has one row per innermost element with the keys and
    fields of all levels; the fields of an outer level are alike in all rows of its element. Null keys come first;
    innermost elements with the same keys go by their text, and repeated ones are written as often as they are there.
    Without rows the outermost list is empty.
    """
    last = len(levels) - 1
    keys = [list(level.keys) for level in levels]
    all_keys = [c for own in keys for c in own]
    outer_fields = dict.fromkeys(c for level in levels[:-1] for c in level.fields if c not in all_keys)
    whole = written(
        rows.withColumn("_text", F.to_json(F.struct(*levels[last].fields), KEEP_NULLS)).groupBy(*all_keys, "_text").agg(
            F.count("*").alias("_n"), *[F.min(c).alias(c) for c in outer_fields]), "document")
    order = ["_place0"]
    for depth, own in enumerate(keys):
        order += [*own, f"_place{depth + 1}"]
    types = {f.name: f.dataType for f in whole.schema.fields}

    def lines(df: DataFrame, depth: int, place: int, text: Column, *ties: Column | str) -> DataFrame:
        """Lines at the opening, in place or at the closing of an element; ``depth`` 0 is the document."""
        known = [c for own in keys[:depth] for c in own]
        places = [F.lit(WITHIN if d < depth else place if d == depth else None).cast("int").alias(f"_place{d}") for d in range(last + 2)]
        rest = [F.lit(None).cast(types[c]).alias(c) for own in keys[depth:] for c in own]
        ties = ties or (F.lit("").alias("_text"), F.lit(0).cast("bigint").alias("_copy"))
        return df.select(*known, *rest, *places, *ties, text.alias("value"))

    parts = [lines(head, 0, OPEN, _opening(head.columns, levels[0].name)),
             lines(head, 0, CLOSE, F.lit("]}"))]
    for depth, level in enumerate(levels):
        outer = [c for own in keys[:depth] for c in own]
        own = F.struct(*level.keys, *(["_text"] if depth == last else []))
        least = whole.groupBy(*outer).agg(F.min(own).alias("_least"))
        if depth == last:
            elements = whole
        else:
            fields = [c for c in level.fields if c in outer_fields]
            elements = whole.groupBy(*outer, *level.keys).agg(F.count("*"), *[F.min(c).alias(c) for c in fields])
        if outer:
            # joined by a text of the keys, which, other than the keys, is never null
            tag = F.to_json(F.struct(*outer), KEEP_NULLS)
            placed = spread_join(elements.withColumn("_parent", tag), least.select(tag.alias("_parent"), "_least"), "_parent")
        else:
            placed = elements.withColumn("_least", least.select("_least").scalar())
        first = own.eqNullSafe(F.col("_least"))
        if depth == last:
            block = F.explode(F.sequence(F.lit(0), F.expr("(_n - 1) div 1000"))).alias("_block")
            copies = placed.select("*", first.alias("_first"), block).select(
                "*", F.explode(F.sequence(F.expr("_block * 1000"), F.least(F.expr("_block * 1000 + 999"), F.col("_n") - 1))).alias("_copy"))
            comma = F.when(F.col("_first") & (F.col("_copy") == 0), F.lit("")).otherwise(F.lit(","))
            parts.append(lines(copies, depth + 1, WITHIN, F.concat(comma, "_text"), "_text", "_copy"))
        else:
            comma = F.when(first, F.lit("")).otherwise(F.lit(","))
            parts.append(lines(placed, depth + 1, OPEN, F.concat(comma, _opening(level.fields, levels[depth + 1].name))))
            parts.append(lines(elements, depth + 1, CLOSE, F.lit("]}")))
    return reduce(DataFrame.unionByName, parts).orderBy(*order, "_text", "_copy").select("value")


def write_document(head: DataFrame, rows: DataFrame, levels: Sequence[Level], path: str) -> None:
    """Write the document to a new folder; a folder that exists is an error, as readers may be at it."""
    document_lines(head, rows, levels).write.text(path)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: number of the file, start of the block, place in the block."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    return spark.read.text(path).select(
        number.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        F.ltrim("value", F.lit(",")).alias("value"))


def read_document(spark: SparkSession, path: str, head: str, levels: Sequence[tuple[str, str]]) -> DataFrame:
    """The innermost elements of a written document, one row each, with a struct per level named as its list, and ``head``.

    ``head`` is the schema of the document's fields, ``levels`` the name and schema of each list. The objects a line
    lies in are the last ones opened before it: within a block of a file by a window, and for the blocks before it by
    one row per block. Lists without elements give no row; ``read_head`` reads the head of any document.
    """
    names = [name for name, _ in levels]
    schemas = [head, *[schema for _, schema in levels]]
    lines = _numbered_lines(spark, path)

    def opened(name: str) -> Column:
        return F.when(F.col("value").endswith(f'"{name}":['), F.col("value"))

    before = Window.partitionBy("part", "block").orderBy("line")
    marked = lines.select("*", *[opened(name).alias(f"_at{i}") for i, name in enumerate(names)])
    carried = marked.select("part", "block", "value", *[F.last(f"_at{i}", ignorenulls=True).over(before).alias(f"_in{i}") for i in range(len(names))])
    ends = marked.groupBy("part", "block").agg(*[F.max_by(f"_at{i}", F.when(F.col(f"_at{i}").isNotNull(), F.col("line"))).alias(f"_at{i}")
                                                 for i in range(len(names))])
    earlier = Window.orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("part", "block", *[F.last(f"_at{i}", ignorenulls=True).over(earlier).alias(f"_from{i}") for i in range(len(names))])
    leaves = carried.where(F.col("value").startswith("{") & F.col("value").endswith("}"))
    found = leaves.join(handed, ["part", "block"], "left")
    texts = [F.concat(F.coalesce(f"_in{i}", f"_from{i}"), F.lit("]}")) for i in range(len(names))] + [F.col("value")]
    return found.select(*[F.from_json(text, schema).alias(name) for text, schema, name in zip(texts, schemas, ["head", *names])])


def read_head(spark: SparkSession, path: str, head: str, first: str) -> DataFrame:
    """The head of a written document, one row; ``first`` is the name of its list."""
    lines = _numbered_lines(spark, path).where(F.col("value").endswith(f'"{first}":['))
    top = lines.agg(F.min_by("value", F.struct("part", "block", "line")).alias("value"))
    return top.select(F.from_json(F.concat("value", F.lit("]}")), head).alias("head")).select("head.*")
