"""Importance weights towards a target by bit-sliced aggregation, and a draw by weight.

Features are runs of one to ``ngram`` words; a feature's bucket is the CRC-32 of its bytes modulo ``buckets``. A bucket's
gain is a whole number, 1000 times the logarithm of how much commoner the bucket is in the target than in the corpus. A
document's weight is the floored mean of the gains of its features.

Counts and gains meet as bits. A document's bucket counts become planes of ``buckets`` bits each: bit b of plane i is bit
i of the count of bucket b. Gains become planes in the same way, those of positive and of negative gains apart. A count
plane AND a gain plane, popcount, times the power of two of both planes, summed over all pairs of planes, is the exact sum
of the gains over all features, without a product per bucket.

The corpus is read twice, once for the counts of all buckets and once for the weights. Only the gains, one per bucket,
pass through the driver: their number is the parameter ``buckets``, whatever the input's size.

The draw takes the highest scores: the weight plus Gumbel noise of a hash of the doc_id. Scores are whole numbers, so
the least drawn one is read from a histogram of the scores, and only rows from it on are ranked, in ranges of their order.

Defined results: null texts, and texts without words, have no features, weight 0. A null doc_id hashes like an empty
one and comes last among equal scores. Rows that are equal in score and doc_id are ranked in any order. An empty corpus
gives no rows; an empty target gives every bucket the same prior.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.ordering import with_starts
from reelwright.session import written

BUCKETS = 10_000
NGRAM = 1
SCALE = 1000
SEED = "2024"
SHARE = 10  # percent of the documents that are long enough
LEAST_WORDS = 20
DOCS_AT_ONCE = 64
#: Lower-cases A-Z and turns all that is no digit, letter or byte beyond ASCII into a space.
LETTERS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def feature_buckets(found: list[bytes], ngram: int, buckets: int) -> np.ndarray:
    """The bucket of each feature of a text's words, repeats included."""
    runs: list[bytes] = list(found)
    for n in range(2, ngram + 1):
        runs.extend(b" ".join(found[i:i + n]) for i in range(len(found) - n + 1))
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def planes(values: np.ndarray) -> np.ndarray:
    """[plane, row, 64-bit word]: the bits of whole numbers from 0 on, [row, bucket], plane i with bit i of each."""
    bits = int(values.max(initial=0)).bit_length()
    width = -(-values.shape[1] // 64) * 8
    sliced = np.zeros((bits, len(values), width), np.uint8)
    for i in range(bits):
        packed = np.packbits((values >> i & 1).astype(np.uint8), axis=1)
        sliced[i, :, :packed.shape[1]] = packed
    return sliced.view(np.uint64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) of all planes that have a bit."""
    signed = [(sign, planes(np.maximum(sign * gains, 0)[None, :])) for sign in (1, -1)]
    return [(sign << i, p[0]) for sign, found in signed for i, p in enumerate(found) if p.any()]


def total_gains(counts: np.ndarray, gains: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """For each row of counts, the sum of count times gain over the buckets."""
    total = np.zeros(len(counts), np.int64)
    for i, plane in enumerate(planes(counts)):
        for power, gain in gains:
            total += (power << i) * np.bitwise_count(plane & gain).sum(1, dtype=np.int64)
    return total


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, text_col: str = "text") -> DataFrame:
    """(bucket, n): the features of all texts by bucket; a task sends one row per bucket at most."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(feature_buckets(words(text.as_py() or b""), ngram, buckets), minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])

    texts = rows.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    return texts.mapInArrow(of_batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, text_col: str = "text",
                 target_col: str = "text") -> np.ndarray:
    """The gain of each bucket, with one added to every count."""
    corpus, aim = (np.zeros(buckets) for _ in range(2))
    for counts, rows, col in ((corpus, docs, text_col), (aim, target, target_col)):
        for r in bucket_counts(rows, buckets, ngram, col).collect():  # at most ``buckets`` rows
            counts[r["bucket"]] = r["n"]
    up = (aim + 1) * (corpus.sum() + buckets)
    down = (corpus + 1) * (aim.sum() + buckets)
    return np.array([math.floor(SCALE * math.log(u / d)) for u, d in zip(up.tolist(), down.tolist())], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): one row per document."""
    buckets, sliced = len(gains), gain_planes(gains)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                found = [words(t.as_py() or b"") for t in part.column(1)]
                features = [feature_buckets(w, ngram, buckets) for w in found]
                counts = np.stack([np.bincount(f, minlength=buckets) for f in features])
                sizes = np.array([len(f) for f in features], np.int64)
                weight = total_gains(counts, sliced) // np.maximum(sizes, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(w) for w in found], pa.int64()), pa.array(sizes), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return narrow.mapInArrow(of_batches, "doc_id long, n_words long, n_features long, weight long")


def scored(weighted: DataFrame, seed: str = SEED) -> DataFrame:
    """With ``score``: the weight plus Gumbel noise, in thousandths."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighted.withColumn("score", F.col("weight") + F.floor(-float(SCALE) * F.log(-F.log(uniform))).cast("long"))


def drawn(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """With ``rank`` among the drawn rows, null for the others: the best scores, ``share`` percent of the long documents.

    ``rows`` is read several times and should be a written table.
    """
    long_enough = F.col("n_words") >= least_words
    histogram = rows.where(long_enough).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # One row per different score: some ten thousand, as weights and noise are bounded, whatever the input's size.
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumn("to_here", F.sum("n").over(above))
    n = rows.where(long_enough).count() * share // 100
    least = summed.where(F.col("to_here") >= n).agg(F.max("score")).first()[0] if n else None
    none = F.lit(None).cast("long")
    if least is None:
        return rows.withColumn("rank", none)
    near = long_enough & (F.col("score") >= least)
    order = rows.where(near).withColumns({"_down": -F.col("score"), "_no_id": F.col("doc_id").isNull(), "_one": F.lit(1)})
    placed = with_starts(order, ["_down", "_no_id", "doc_id"], "_one")
    place = F.col("start") + 1
    ranked = placed.withColumn("rank", F.when(place <= n, place)).select(*rows.columns, "rank")
    return ranked.unionByName(rows.where(~near).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, share: int = SHARE,
              least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document, with its place in the draw."""
    gains = bucket_gains(docs, target, buckets, ngram)
    return drawn(written(scored(weights(docs, gains, ngram), seed), "weights"), share, least_words)


#: Words by regular expression, CRC-32 by its table, sums by bucket.
IMPORTANCE_SQL = r"""
WITH crc_table AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_concat([n::BIGINT], range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(n))),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
aim_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
singles AS (SELECT r, unnest(ws) AS w FROM doc_words),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM singles UNION ALL SELECT w FROM aim_words)),
hashed AS (SELECT w, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket FROM vocabulary, crc_table),
corpus AS (SELECT bucket, count(*) AS s FROM singles JOIN hashed USING (w) GROUP BY ALL),
aim AS (SELECT bucket, count(*) AS t FROM aim_words JOIN hashed USING (w) GROUP BY ALL),
gains AS (SELECT c.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM singles) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM aim_words) + 10000)::DOUBLE)))::BIGINT AS gain FROM corpus c LEFT JOIN aim USING (bucket)),
sums AS (SELECT r, sum(gain)::BIGINT AS total FROM singles JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY ALL),
weighed AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / len(ws)), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM doc_words d LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM ranked) * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
