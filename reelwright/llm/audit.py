"""How quality filters overlap, counted by a stream that takes back what later files change.

Every document gets a mask, one bit per filter that it fails. Counters by part and mask say all there is to say about
every order of the filters: what a filter removes at its step is the sum of the masks with its bit and none of the
bits before. So the stream keeps counters by mask, and the 120 orders are read from them at the end.

The files are read as micro-batches. Four filters look at one text only. The last one, repeated text, depends on the
whole table: a document fails it if a smaller doc_id has the same text. State by text keeps the least doc_id met, with the
documents that have it. When a micro-batch brings a smaller one, the earlier ones are taken out of the counter of their
mask and added to that with the bit of repeats; the counters are right after every micro-batch for all files so far.

State is a log: a micro-batch writes the new least documents as a segment of its own and its changes of the counters
as another, named by its number, and reads only segments of smaller numbers. So a micro-batch that is run again writes the same,
and none rewrites state. A segment holds hashes, ids and masks, no text; one of least documents also names those that it takes back (``old``).

Defined results: null texts are empty; a null part is the empty part. A null doc_id is smaller and greater than none, so
its document neither fails by repeats nor lets others fail. Repeated rows count each; of equal ids none is smaller. Labels
of a doc_id that has several rows count if any says so. Texts are told apart by SHA-256. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelwright.operators.grouping import spread_join
from reelwright.session import shared_folder, shuffles_released

LETTERS = "ABCDE"
REPEAT = 1 << LETTERS.index("E")
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # percent of the words
MOST_CAPITALS = 2  # percent of the code points
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(0x41, 0x5B))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
MICRO_BATCHES = 8

MARKS = "doc_id long, part string, mask int, key binary"
ROWS = "key binary, doc_id long, part string, mask int, good int, toxic int, n long, old boolean"
CHANGES = "part string, mask int, n long, good long, toxic long"


def failed(text: bytes) -> int:
    """The mask of the filters that look at one text."""
    words = text.split()  # of bytes: white space 0x20 and 0x09 to 0x0D
    few = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    loud = 100 * capitals > MOST_CAPITALS * len(text.translate(None, CONTINUED))
    return few | dull << 1 | loud << 2 | (SIGNS.search(text) is not None) << 3


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([failed(t) for t in texts], pa.int32()),
             pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "part", "mask", "key"])


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, key): what can be said of each document alone."""
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), part.alias("part"),
                       F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(_marked, MARKS)


def label_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic): one row per labelled document."""
    said = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*said)


def _changes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


class Folder:
    """The segments of one audit in the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        for name, schema in (("heads", ROWS), ("changes", CHANGES)):
            self.write(spark.createDataFrame([], schema), name, -1)

    def write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        """Write a segment, in place of what an earlier try left, and read it back."""
        path = f"{self.path}/{name}/segment={number}"
        with shuffles_released(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def before(self, spark: SparkSession, name: str, schema: str, number: int) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.path}/{name}/segment={i}" for i in range(-1, number)])


def take(batch: DataFrame, number: int, labels: DataFrame, folder: Folder, **columns: str) -> None:
    """Add one micro-batch to the state and write the changes of the counters."""
    spark = batch.sparkSession
    files = max(1, batch.rdd.getNumPartitions())  # a segment has as many as the texts were read in, not as shuffles have partitions
    labelled = spread_join(marks(batch, **columns), spark.read.schema(labels.schema).parquet(f"{folder.path}/labels"), "doc_id", "left")
    rows = folder.write(labelled.select("key", "doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"),
                                        F.coalesce("toxic", F.lit(0)).alias("toxic"), F.lit(1).cast("long").alias("n")).coalesce(files), "marks", number)
    # Of each text only its least documents move, cut down before they are shuffled, so that many copies are few rows.
    first = rows.where("doc_id is not null").withColumn("rank", F.rank().over(Window.partitionBy("key").orderBy("doc_id"))).where("rank = 1")
    own = first.groupBy("key", "doc_id", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).withColumn("old", F.lit(False))
    kept = folder.before(spark, "heads", ROWS, number).where("not old").withColumn("old", F.lit(True))
    # A text may have been met any number of times before.
    text, old = Window.partitionBy("key"), F.col("old")
    placed = own.unionByName(kept).select(
        "*", F.min("doc_id").over(text).alias("least"), F.min(F.when(old, F.col("doc_id"))).over(text).alias("was"))
    is_least = F.col("doc_id") == F.col("least")
    overtaken = (F.col("doc_id") == F.col("was")) & (F.col("least") < F.col("was"))
    heads = folder.write(placed.where((~old & is_least) | (old & overtaken)).select(*own.columns).coalesce(files), "heads", number)
    repeated = F.col("mask").bitwiseOR(F.lit(REPEAT))
    # All count as repeats; least documents are taken out of these again, overtaken ones are put in.
    counted = rows.withColumn("mask", F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(repeated))
    least_n = F.when(old, -F.col("n")).otherwise(F.col("n"))
    both = F.explode(F.array(F.struct("mask", least_n.alias("n")), F.struct(repeated.alias("mask"), (-least_n).alias("n")))).alias("c")
    corrected = heads.select("part", "good", "toxic", both).select("part", "c.mask", "good", "toxic", "c.n")
    union = counted.select(*corrected.columns).unionByName(corrected)
    folder.write(_changes(union).select("part", "mask", "n", "good", "toxic").coalesce(files), "changes", number)


def counters(spark: SparkSession, path: str, labels: DataFrame, micro_batches: int = MICRO_BATCHES, folder: str | None = None,
             **columns: str) -> DataFrame:
    """(part, mask, n, good, toxic) of all documents under a path, by a stream over its files that ends with the last one.

    ``micro_batches`` is how many the files are dealt into. A run that was broken off goes on with the same ``folder``.
    """
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    base = folder or shared_folder(spark, "audit")
    state = Folder(spark, base)
    said = label_rows(labels)
    said.write.mode("overwrite").parquet(f"{base}/labels")
    # A glob lets a table of one file be a stream, too.
    stream = (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // micro_batches)))
              .parquet(f"{path.rstrip('/')}*"))
    started = (stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, said, state, **columns))
               .option("checkpointLocation", f"{base}/stream").trigger(availableNow=True).start())
    started.awaitTermination()
    total = spark.read.schema(CHANGES).parquet(f"{base}/changes/segment=*")
    return total.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def report(counted: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters by mask."""
    bit = {letter: 1 << i for i, letter in enumerate(LETTERS)}
    steps = [("".join(order), k + 1, bit[order[k]], sum(bit[x] for x in order[:k]))
             for order in permutations(LETTERS) for k in range(len(order))]
    spark = counted.sparkSession
    table = spark.createDataFrame(steps, "filter_order string, step int, bit int, earlier int")
    cases = sorted({(b, e) for _, _, b, e in steps})
    orders = len(steps) // len(LETTERS)
    # 32 masks to a part at most, so a part's counters are one row.
    entry = F.struct(F.col("mask").alias("mask"), "n", "good", "toxic")
    parts = counted.groupBy("part").agg(F.collect_list(entry).alias("masks"))
    case = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for b, e in cases])).alias("c")
    rows = parts.select("part", "masks", case).select("part", "masks", "c.bit", "c.earlier")
    none = F.lit(0).cast("long")

    def total(value: str, where):
        return F.aggregate(F.filter("masks", where), none, lambda a, m: a + m[value])

    def fails(m, bits: str):
        return m["mask"].bitwiseAND(F.col(bits)) != 0

    shares = F.aggregate(F.filter("masks", lambda m: fails(m, "bit")), none,
                         lambda a, m: a + (m["n"] * (F.lit(orders) / F.bit_count(m["mask"])).cast("long")).cast("long"))
    counted_steps = rows.select(
        "part", "bit", "earlier",
        total("n", lambda m: ~fails(m, "bit") & ~fails(m, "earlier")).alias("kept"),
        total("n", lambda m: fails(m, "bit") & ~fails(m, "earlier")).alias("removed"),
        total("n", lambda m: fails(m, "bit") & fails(m, "earlier")).alias("redundant"),
        total("n", lambda m: m["mask"] == F.col("bit")).alias("unique_fails"),
        total("good", lambda m: fails(m, "bit") & ~fails(m, "earlier")).alias("good_lost"),
        total("toxic", lambda m: fails(m, "bit") & ~fails(m, "earlier")).alias("toxic_lost"),
        shares.alias("shapley"))
    return counted_steps.join(table, ["bit", "earlier"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: Masks by window and regular expression, then every order of the five filters.
AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
flags AS (SELECT doc_id, part, len(ws) < 200 AS a, 100 * list_unique(ws) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM words),
masks AS (SELECT doc_id, part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask FROM flags),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY ALL),
counters AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN said USING (doc_id) GROUP BY ALL),
bits AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order FROM bits p, bits q, bits r, bits s, bits t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
steps AS (SELECT filter_order, step::INT AS step, bit, coalesce((SELECT sum(o.bit) FROM bits o WHERE position(o.f IN filter_order) < step), 0)::INT AS earlier FROM orders, range(1, 6) x(step), bits WHERE bits.f = substr(filter_order, step, 1))
SELECT part, filter_order, step, sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
sum(CASE WHEN mask & bit > 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM counters, steps GROUP BY ALL
"""
