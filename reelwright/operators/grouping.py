"""Grouping helpers that stay cheap when one key holds a large share of the rows.

A window over a hot key sorts all its rows in one task. These helpers avoid that: group
values come from aggregates that combine before the shuffle, and are joined back with a join
whose hot partition AQE can split; ranked picks use a small k, for which Spark drops all but k
rows per key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Equi join of rows with a side that has one row per key, safe for hot keys on the left.

    AQE splits a hot partition only when both sides come straight from a shuffle made for the
    join. A side that was just grouped by the keys would skip that shuffle and rule the split
    out. The extra hash in the join key asks for it: the grouped side, one row per key, moves
    once more, and a key with a third of all rows is worked on by many tasks. The hash comes first, as
    a sort tells rows apart by eight bytes of the first key, and texts such as paths begin alike.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    spread = F.xxhash64(*names)
    joined = left.withColumn("_spread", spread).join(right.withColumn("_spread", spread), ["_spread", *names], how)
    return joined.drop("_spread")


def with_hash(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``_hash`` of the keys, to group or join by before the keys when they are long texts: a sort then goes by it."""
    return df.withColumn("_hash", F.xxhash64(*keys))


def grouped(df: DataFrame, keys: Sequence[str]) -> GroupedData:
    """``df`` by keys that are long texts, and by their ``_hash``."""
    return with_hash(df, keys).groupBy("_hash", *keys)


def attach_group_values(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """Every row with aggregates of its group; keys must not be null."""
    keys = list(keys)
    totals = grouped(df, keys).agg(*[v.alias(n) for n, v in values.items()]).drop("_hash")
    return spread_join(df, totals, keys)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key in a total order, with their rank."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in a total order."""
    return top_per_key(df, keys, order, 1, "_rank").drop("_rank")


def counts_with_range(rows: DataFrame, value: str) -> tuple[DataFrame, Column, Column]:
    """Rows per different value as ``n``, and the least and greatest value.

    The range is read from the counts, and reads their ``n`` too, so that both share one exchange and the
    input is built once.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    ends = counts.select(F.struct(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("n").alias("n"))).scalar()
    return counts, ends["low"], ends["high"]


def joined_top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
               value: str, separator: str, name: str) -> DataFrame:
    """Per key, the first ``k`` values joined into one text."""
    top = top_per_key(df, keys, order, k, "_rank")
    pairs = F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("v"))))
    return top.groupBy(*keys).agg(
        F.array_join(F.transform(pairs, lambda p: p["v"]), separator).alias(name)
    )
