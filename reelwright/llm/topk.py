"""Exact top-k search by inner product over vectors in order of length.

Vectors are rotated onto the right singular vectors of the whole table (from the eigenvectors of the
small matrix of products of its columns), so that the first numbers hold most of each product. The
rows are dealt into blocks in descending order of length. A query has a bar, the k-th score of what
it has met so far:

* first it meets the block of the longest vectors, which gives the bar;
* it meets another block only if its length times the block's greatest length reaches the bar;
* inside a block the rows still in the race get a partial product over a few leading numbers more,
  and leave when that, plus the product of the remaining lengths (Cauchy-Schwarz), falls below the bar;
* what stays is scored in whole numbers, so results do not depend on rounding.

Queries are met in blocks as well, by an equality join on the query block's number; a block of rows
is copied only to the query blocks that it may matter to. Each meeting of two blocks gives at most k
rows per query, and the best k of all meetings are the result.

Defined results: vectors that are null, or hold null, NaN or infinite numbers, take no part, neither
as queries nor as candidates; nor do rows without an id. Shorter vectors count as filled with zeros.
Rows equal in id and vector count once. A row is never a candidate of a query with its own id. Equal
scores go to the smaller id, and with equal ids and scores to either row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.session import written

BLOCK_ROWS = 4096
QUERY_ROWS = 512
STEPS = 4  # partial products before the whole one
SLACK = 1e-6  # relative; far above the rounding of the rotated numbers


def usable(vectors: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): whole numbers floor(scale * x), of rows with an id and only finite numbers."""
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"),
    ).distinct()


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4))
    out = np.zeros((len(column), dims), np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    cols = np.arange(len(flat)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    out[rows, cols] = flat
    return out


def _rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors, largest singular value first; each task sends one dims by dims matrix."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            m = _matrix(batch.column(0), dims).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(dims), dims), pa.int32()), pa.array(np.tile(np.arange(dims), dims), pa.int32()),
             pa.array(total.ravel())], ["i", "j", "x"])

    sums = rows.select("v").mapInArrow(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((dims, dims))
    for r in sums.collect():
        gram[r.i, r.j] = r.x
    _, vectors = np.linalg.eigh(gram)
    return vectors[:, ::-1]


def _pack(dims: int):
    """Rows of one block as one row: ids, vectors, greatest length."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for ids, vectors in zip(batch.column(1), batch.column(2)):
                m = _matrix(vectors.values, dims)
                packed.append((np.array(ids.values, "<i8").tobytes(), m.astype("<i8").tobytes(),
                               float(np.sqrt((m.astype(float) ** 2).sum(1)).max())))
            cols = list(zip(*packed)) or [()] * 3
            types = (pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             ["block", "ids", "vectors", "longest"])

    return of_batches


PACKED = "block long, ids binary, vectors binary, longest double"


def _blocks(rows: DataFrame, order: str, size: int, dims: int, by_row: bool) -> DataFrame:
    """Blocks of about ``size`` rows; in order of length, or by a hash of the id (``by_row``)."""
    n = rows.count()
    count = max(1, -(-n // size))
    if by_row:
        numbered = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)))
    else:
        ranged = written(rows.repartitionByRange(count, F.desc(order), "vec_id", "v").withColumn(
            "range", F.spark_partition_id()), "by-length")
        # A range may hold more rows than a block; it is cut again by a hash.
        parts = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        numbered = ranged.join(F.broadcast(parts), "range").withColumn(
            "block", F.col("range") * F.lit(1 << 20) + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    grouped = numbered.groupBy("block").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
    return written(grouped.mapInArrow(_pack(dims), PACKED), "blocks")


def _race(q: np.ndarray, qids: np.ndarray, bars: np.ndarray, c: np.ndarray, cids: np.ndarray, rotation: np.ndarray,
          k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query index, ids, scores) of the best k candidates that reach a query's bar."""
    dims = q.shape[1]
    rq, rc = q.astype(float) @ rotation, c.astype(float) @ rotation
    edges = sorted({round(dims * s / (STEPS * 2)) for s in range(1, STEPS + 1)} - {0})

    def rests(m: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt((m[:, e:] ** 2).sum(1)) for e in edges]

    q_rests, c_rests = rests(rq), rests(rc)
    q_len, c_len = np.sqrt((rq ** 2).sum(1)), np.sqrt((rc ** 2).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c, cids, rc, c_len = c[order], cids[order], rc[order], c_len[order]
    c_rests = [r[order] for r in c_rests]
    for i in range(len(q)):
        slack = SLACK * q_len[i] * (c_len[0] if len(c_len) else 0.0) + 1e-9
        # Lengths fall, so the rows that can reach the bar are the first ones.
        if bars[i] > 0:
            n = int(np.searchsorted(-(c_len * q_len[i] + slack), -bars[i], "right"))
        else:
            n = len(c_len)
        alive = np.arange(n)
        partial = np.zeros(n)
        at = 0
        for e, q_rest, c_rest in zip(edges, q_rests, c_rests):
            if not len(alive) or not np.isfinite(bars[i]):
                break
            partial = partial + rc[alive, at:e] @ rq[i, at:e]
            keep = partial + c_rest[alive] * q_rest[i] + slack >= bars[i]
            alive, partial, at = alive[keep], partial[keep], e
        alive = alive[cids[alive] != qids[i]]
        if not len(alive):
            continue
        scores = c[alive] @ q[i]
        best = np.lexsort((cids[alive], -scores))[:k]
        yield i, cids[alive][best], scores[best]


MET = "query_id long, row long, vec_id long, score long"


def _meet(rotation: np.ndarray, k: int):
    dims = len(rotation)

    def matrix(data: pa.Scalar) -> np.ndarray:
        return np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dims)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_block, q_ids, qs, bars, c_ids, cs in zip(*batch.columns):
                ids, cids = (np.frombuffer(x.as_buffer(), "<i8") for x in (q_ids, c_ids))
                bar = np.array(bars.as_py(), float) if bars.is_valid else np.full(len(ids), -np.inf)
                out = [(np.full(len(found), ids[i]), np.full(len(found), i), found, scores) for i, found, scores in
                       _race(matrix(qs), ids, bar, matrix(cs), cids, rotation, k)]
                if out:
                    cols = [np.concatenate([o[j] for o in out]) for j in range(4)]
                    cols[1] = cols[1] + q_block.as_py() * (1 << 20)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.astype(np.int64)) for x in cols], ["query_id", "row", "vec_id", "score"])

    return of_batches


def top_k(vectors: DataFrame, queries: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that meets the condition ``queries``."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, scale, id_col, vec_col), "vectors")
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if dims is None:
        return empty
    dims = max(1, dims)
    rotation = _rotation(rows, dims)
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    candidates = _blocks(rows.withColumn("length", squared), "length", block_rows, dims, by_row=False)
    asked = _blocks(rows.where(queries), "vec_id", query_rows, dims, by_row=True).select(
        F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    first = candidates.agg(F.min("block")).first()[0]
    meet = _meet(rotation, k)
    by_score = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")

    def best(met: DataFrame) -> DataFrame:
        return met.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    def met(pairs: DataFrame) -> DataFrame:
        return pairs.select("q", "q_ids", "q_vectors", "bars", "ids", "vectors").mapInArrow(meet, MET)

    # Every query block meets the first block; the number is a column, so this is an equality join.
    opened = asked.withColumn("block", F.when(F.col("q") >= 0, F.lit(first)))
    no_bars = opened.join(candidates, "block").withColumn("bars", F.lit(None).cast("array<double>"))
    opening = written(best(met(no_bars)), "opening")
    reached = opening.where(F.col("rank") == k).select("row", F.col("score").cast("double").alias("bar"))
    bars = reached.groupBy(F.floor(F.col("row") / (1 << 20)).alias("q")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("row") % (1 << 20)).cast("int").alias("i"), "bar"))).alias("by_row"))
    sizes = asked.withColumn("n", F.floor(F.length("q_ids") / 8).cast("int"))
    lowest = F.lit(float("-inf"))
    with_bars = written(sizes.join(bars, "q", "left").withColumn("bars", F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.coalesce(F.try_element_at(F.col("by_row"), i), lowest))).drop("by_row", "n"), "bars")
    lengths = with_bars.select("q", "bars", "q_vectors").mapInArrow(_least_length(dims), "q long, needed double")
    # Only the numbers of blocks are paired, those that may matter to each other; few, as blocks are large.
    numbers = candidates.where(F.col("block") != first).select("block", "longest")
    pairs = numbers.join(F.broadcast(lengths), F.col("longest") * F.lit(1 + SLACK) >= F.col("needed")).select("block", "q")
    later = candidates.join(pairs, "block").select("q", "ids", "vectors").join(with_bars, "q")
    found = best(opening.drop("rank").unionByName(met(later)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _least_length(dims: int):
    """Per query block, the least length of a vector that may still reach some query's bar."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needed = []
            for bars, data in zip(batch.column(1), batch.column(2)):
                q = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dims).astype(float)
                size = np.maximum(np.sqrt((q ** 2).sum(1)), 1e-12)
                bar = np.array(bars.as_py(), float)
                needed.append(float(np.where(bar > 0, bar / size, -np.inf).min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(needed, pa.float64())], ["q", "needed"])

    return of_batches


#: DuckDB: the five best of every row for the rows whose id is divisible by 50.
TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
