"""Mixture-controlled packing of documents into token sequences of one length.

Each source is a queue of documents in the order of the input's partitions. The queue is cut into slices of ``SLICE``
tokens, and deficit round-robin says when a slice is sent: in every round, which stands for one window of ``WINDOW``
tokens, a source is given its part of the window as credit; when the credit reaches a slice, the slice is sent and its
size is taken off, and what is left of the credit is carried into the next round. A source starts with a credit between
nothing and one slice, by a hash of its name, so that small sources are spread over all windows. After round r a source
of credit c a round has sent floor(r c / SLICE + its first credit) slices, so the round of slice i is known from i alone:
no task hands its deficits to the next, and windows and partitions go on from each other as if one task had filled them.

The slices in the order of rounds are one stream of tokens, cut into windows. What is left at the end becomes windows of
powers of two, so no token is padding. Without weights a source's part of a window is its part of all tokens, and all
queues end together; with weights, a queue that is empty leaves its room to the others.

Texts are encoded once and written with the place in their queue inside the task's part; only totals by task and source,
and by group of rounds, are summed up before the one shuffle of the tokens, by groups of rounds.

Defined results: null and empty texts have the end id only. A null source is a source. Repeated rows are packed each.
Sources that the weights do not name, or name with null or nothing above zero, weigh 1. An empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.llm.ordering import with_starts
from reelwright.llm.records import parts
from reelwright.session import shuffles_released, written

WINDOW = 2048
SLICE = 256
GROUP_TOKENS = 1 << 22  # that a task sorts and cuts at once, about
UNIT = 1 << 20

TOKENS = "task int, queue string, before long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokens(docs: DataFrame, tokenizer: str, end_id: int, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text",
           source_col: str = "source") -> DataFrame:
    """Encoded documents with their queue and the ids before them that the same task put into it."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reelwright.llm.records import encoder as shared

        encode = shared(tokenizer, id_bytes).encode
        end = int(end_id).to_bytes(id_bytes, "little")
        task = TaskContext.get().partitionId()
        filled: dict[str, int] = {}
        for batch in batches:
            for part in parts(batch):
                found = [ids + end for ids in encode([t or "" for t in part.column(1).to_pylist()])]
                queues, sizes, before = part.column(2).to_pylist(), [len(x) // id_bytes for x in found], []
                for queue, size in zip(queues, sizes):
                    before.append(filled.get(queue, 0))
                    filled[queue] = before[-1] + size
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(found), pa.int32()), part.column(2), pa.array(before, pa.int64()), part.column(0),
                     pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["task", "queue", "before", "doc_id", "n", "ids"])

    source = F.col(f"`{source_col}`").cast("string")
    queue = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))  # a null is no value
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), queue.alias("queue"))
    return narrow.mapInArrow(of_batches, TOKENS)


def credits(queues: DataFrame, window: int, size: int, weights: DataFrame | None) -> DataFrame:
    """(queue, rounds, first): rounds that a slice's credit takes, and the part of a slice that is missing at first."""
    weight = (F.ceil(F.col("total") / size) * size).cast("double")
    if weights is not None:
        source = F.col("source").cast("string")
        named = weights.groupBy(F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("queue")).agg(
            F.max(F.col("weight").cast("double")).alias("weight"))
        queues = queues.join(named, "queue", "left")
        weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)
    weighed = queues.select("queue", weight.alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0] or 1.0
    first = (F.pmod(F.xxhash64("queue"), F.lit(UNIT)) + 0.5) / UNIT
    return weighed.select("queue", (size * total / (window * F.col("weight"))).alias("rounds"), first.alias("first"))


def tail_ends(left: int) -> list[int]:
    """Where the windows of powers of two end that hold what is left, the largest first."""
    sizes = [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
    return np.cumsum(sizes).tolist()


def cutter(window: int, total: int, id_bytes: int):
    """Cuts pieces, which come in order inside their group, at the ends of windows."""
    full = total // window
    ends = np.array(tail_ends(total - full * window), np.int64) + full * window
    starts = np.concatenate(([full * window], ends))

    def window_at(place: int) -> tuple[int, int, int]:
        """Number, begin and end of the window at a place."""
        if place < full * window:
            number = place // window
            return number, number * window, (number + 1) * window
        i = int(np.searchsorted(ends, place, "right"))
        return full + i, int(starts[i]), int(ends[i])

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, place = None, 0
        for batch in batches:
            rows: list[tuple] = []
            for own, base, doc_id, n, start, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != group:
                    group, place = own, base
                at, size = 0, len(ids) // id_bytes
                while at < size:
                    number, begin, end = window_at(place)
                    length = min(size - at, end - place)
                    rows.append((doc_id, start + at, length, ids[at * id_bytes:(at + length) * id_bytes], n, number, place - begin))
                    at, place = at + length, place + length
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=[f.split()[0] for f in PIECES.split(", ")])

    return of_batches


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, size: int = SLICE, id_bytes: int = 2,
           weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The pieces of the sequences, with their ids, as a written table in the order of the sequences.

    ``weights`` (source, weight) sets the parts of a window; without, each source has its part of all tokens.
    """
    spark = docs.sparkSession
    encoded = written(tokens(docs, tokenizer, end_id, id_bytes, id_col, text_col, source_col), "tokens")
    by_task = encoded.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    bases = written(with_starts(by_task, ["task"], "n", by=["queue"]).select("queue", "task", F.col("start").alias("base")), "bases")
    queues = written(by_task.groupBy("queue").agg(F.sum("n").alias("total")), "queues")
    total = queues.agg(F.sum("total")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], PIECES)
    turns = written(credits(queues, window, size, weights), "turns")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_TOKENS))
    rounds = max(1, -(-total // (window * groups)))  # of a group
    placed = encoded.join(bases, ["queue", "task"]).join(turns, "queue").withColumn("at", F.col("base") + F.col("before"))

    def slices(rows: DataFrame, *more: str) -> DataFrame:
        """The part of a document that lies in each slice of its queue: its place in the queue, its group of rounds."""
        numbers = F.sequence(F.expr(f"`at` div {size}"), F.expr(f"(`at` + n - 1) div {size}"))

        def part(i):
            lo, hi = F.greatest(F.col("at"), i * size), F.least(F.col("at") + F.col("n"), (i + 1) * size)
            turn = F.ceil((i + F.col("first")) * F.col("rounds")).cast("long")
            ids = [F.substring("ids", ((lo - F.col("at")) * id_bytes + 1).cast("int"), ((hi - lo) * id_bytes).cast("int")).alias(m) for m in more]
            return F.struct(turn.alias("turn"), lo.alias("lo"), (hi - lo).alias("length"), *ids)

        cut = rows.select("queue", "doc_id", "n", "at", F.explode(F.transform(numbers, part)).alias("s"))
        return cut.select("queue", "doc_id", "n", (F.col("s.lo") - F.col("at")).alias("start"), "s.*",
                          F.expr(f"s.turn div {rounds}").alias("group"))

    sizes = slices(placed).groupBy("group").agg(F.sum("length").alias("size"))
    before = written(with_starts(sizes, ["group"], "size").select("group", F.col("start").alias("group_at")), "groups")
    pieces = slices(placed, "ids").join(before, "group").repartition(groups, "group").sortWithinPartitions("group", "turn", "queue", "lo")
    ordered = pieces.select("group", "group_at", "doc_id", "n", "start", "ids")
    with shuffles_released(spark):
        return written(ordered.mapInArrow(cutter(window, total, id_bytes), PIECES), "sequences")


def digests(pieces: DataFrame, id_bytes: int = 2) -> DataFrame:
    """Pieces with the CRC-32 of their ids as 32-bit numbers in place of the ids."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{id_bytes}").astype("<u4").tobytes()) for x in batch.column("ids")]
            at = batch.schema.get_field_index("ids")
            yield batch.set_column(at, "ids_crc32", pa.array(found, pa.int64()))

    return pieces.mapInArrow(of_batches, PIECES.replace("ids binary", "ids_crc32 long"))


def sequences(pieces: DataFrame, window: int = WINDOW, id_bytes: int = 2, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): whole sequences, at most one window each, padded unless their length is a power of two."""
    parts_in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    found = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts_in_order.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.lit(int(pad_id).to_bytes(id_bytes, "little"))
    n = F.col("length")
    missing = F.when(F.bit_count(n) == 1, 0).otherwise(window - n).cast("int")
    padding = F.aggregate(F.array_repeat(pad, missing), F.lit(b""), lambda a, p: F.concat(a, p))
    return found.select("sequence_id", "length", F.concat(joined, padding).alias("ids"))
