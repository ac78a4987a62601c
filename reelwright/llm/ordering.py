"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.operators.grouping import spread_join
from reelwright.session import written


def with_starts(rows: DataFrame, order: Sequence[str], size: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``start``: the total ``size`` of the rows before, in order, among those with equal ``by``.

    Rows are dealt into ranges of the order and written; a range adds the totals of the ranges before
    it, of which there is one row per range (and ``by``). ``rows`` should be narrow. Rows that are equal
    in the order come after each other in any way; a last key without ties lets them lie in several
    ranges. ``by`` must not be null.
    """
    keys = [*order, "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range", *by).agg(F.sum(size).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *by, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = spread_join(local, bases, ["_range", *by])
    return joined.withColumn("start", F.col("_base") + F.col("_before")).drop("_row", "_range", "_base", "_before")
