"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.operators.grouping import spread_join, top_per_key

UNIT = 1 << 30


def least_hashed(rows: DataFrame, key: str, hash_col: str, k: int) -> DataFrame:
    """(key, hash): the ``k`` least mixed hashes of each key among different pairs; keys must not be null.

    Pairs are thinned by their hash to about 2k per key first, so that no task ranks a large key.
    """
    place = F.pmod(F.xxhash64(hash_col), F.lit(UNIT))
    pairs = rows.select(key, hash_col).distinct().withColumn("_place", place)
    sizes = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    # A key with few rows keeps them all; at 2k + 100 expected, fewer than k is out of the question.
    near = spread_join(pairs, sizes, key).where(F.col("_place") * F.col("_size") <= F.lit((2 * k + 100) * UNIT))
    return top_per_key(near, [key], [F.col("_place"), F.col(hash_col)], k).select(key, hash_col)
