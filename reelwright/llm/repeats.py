"""Repeated windows of bytes by a depth-limited radix sort.

Every position of every text starts a suffix, of which only the first ``length`` bytes count.
Suffixes are ordered by most-significant-digit passes over content, and a suffix leaves as soon
as its group has one member; what is equal after the last pass is exactly the repeated windows.

The first digit is the least hashed gram among the grams of the window, with its place. It is the
same for equal windows, and neighbouring suffixes share it, so a pass moves runs of suffixes, about
two for ``length`` bytes of text, instead of single ones:

1. Runs are grouped by their gram. A run that is alone leaves. If all runs of a group hold the same
   bytes, all their suffixes repeat, and the group is settled.
2. In the other groups each different run, once with its count, is cut into blocks of 16 suffixes.
   The next digit of a block is the bytes that all its suffixes share. A group of equal blocks is settled.
3. Blocks that still meet a different run are cut into single suffixes, whose last digit is all
   ``length`` bytes.

Digits are compared as 64-bit hashes within the group of the digits before, so that two suffixes
taken as equal agree in at least 128 bits. Groups are counted by aggregates that combine before the
shuffle, and no task holds a group.

Defined results: null and empty texts, and texts shorter than ``length``, have no window and keep
all their bytes. Rows are told apart by id and text, so repeated ids are fine; a repeated row counts
as another place and gets its own equal result. Null ids are allowed. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.operators.grouping import spread_join
from reelwright.session import written

GRAM = 48
BLOCK = 16
SLICE = 1 << 21  # bytes worked on at once
PLACE_BITS = 22  # a place in a slice, below the hash
KEY = ["id", "digest"]


def _key(id_col: str, text_col: str) -> list[Column]:
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col(id_col).isNull(), F.col(text_col).cast("binary")).alias("digest"),
    ]


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("bytes")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, bytes): rows under a key without nulls that only equal rows share."""
    return docs.select(*_key(id_col, text_col), _bytes(text_col))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte; powers of an odd base and of its inverse, modulo 2^64."""
    rng = np.random.Generator(np.random.PCG64(7))
    per_byte = rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    n = SLICE + (1 << 12)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return per_byte, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the gram at each place."""
    per_byte, up, down = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(per_byte[data] * up[:len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the place of its least one, the leftmost of equals."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    v = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, ~np.uint64(0))
    padded[:len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return (np.minimum(ahead[:n], behind[width - 1:width - 1 + n]) & mask).astype(np.int64)


def slice_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, count, offset of the gram, gram hash) of the runs of windows inside texts that end at ``ends``."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    h = _gram_hashes(data, gram)
    place = _least_places(h, length - gram + 1)
    # Only windows inside one text count.
    bounds = np.concatenate(([0], ends))
    size = np.diff(bounds)
    inside = np.zeros(len(place) + 1, np.int8)
    fits = size >= length
    np.add.at(inside, bounds[:-1][fits], 1)
    stops = bounds[1:][fits] - length + 1
    np.add.at(inside, stops, -1)
    valid = np.cumsum(inside[:-1]) > 0
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    stop = np.zeros(len(place), bool)
    stop[:-1] = change[1:] | ~valid[1:]
    stop[-1] = True
    last = np.flatnonzero(stop & valid)
    return first, last - first + 1, place[first] - first, h[place[first]]


def _slices(sizes: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, from byte, to byte) of slices: many rows, or a part of one long row."""
    begin = np.concatenate(([0], np.cumsum(sizes)))
    row = 0
    while row < len(sizes):
        if sizes[row] > SLICE:
            for at in range(0, int(sizes[row]) - length + 1, SLICE - length + 1):
                yield row, row + 1, int(begin[row]) + at, int(min(begin[row] + at + SLICE, begin[row + 1]))
            row += 1
            continue
        until = max(row + 1, int(np.searchsorted(begin, begin[row] + SLICE, "right")) - 1)
        yield row, until, int(begin[row]), int(begin[until])
        row = until


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and the size of each row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], np.diff(offsets)


RUNS = "id long, digest long, start int, n int, off int, gram long, run long"


def runs(texts: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """Runs of suffixes that share their first digit: place, count, gram, and a hash of all their bytes."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, sizes = _text_bytes(batch.column(2))
            begin = np.concatenate(([0], np.cumsum(sizes)))
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, until, lo, hi in _slices(sizes, length):
                part = data[lo:hi]
                ends = begin[row + 1:until + 1] - lo if until > row + 1 else np.array([hi - lo])
                first, n, off, gram_hash = slice_runs(part, ends, length, gram)
                if not len(first):
                    continue
                raw = part.tobytes()
                spans = zip(first.tolist(), (first + n - 1 + length).tolist(), (off * 4096 + n).tolist())
                whole = np.array([xxhash.xxh3_64_intdigest(raw[a:b], s) for a, b, s in spans], np.uint64)
                at = np.searchsorted(ends, first, "right") + row
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at]), pa.array(digests[at]), pa.array((first + lo - begin[at]).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)),
                    pa.array(gram_hash.view(np.int64)), pa.array(whole.view(np.int64)),
                ], ["id", "digest", "start", "n", "off", "gram", "run"])

    return texts.mapInArrow(of_batches, RUNS)


def _with_bytes(texts: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """Each of the ``members`` (runs) with its bytes, cut from the texts."""
    wanted = members.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "n", "off", "gram", "run", "copies"))).alias("wanted")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, text, rows in zip(*[c for c in batch.columns]):
                raw = text.as_py()
                out = [(key.as_py(), digest.as_py(), *r.values(), raw[r["start"]:r["start"] + r["n"] - 1 + length])
                       for r in rows.as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), CUT)], names=[f.name for f in CUT])

    # One of equal rows is enough: their runs are counted in ``copies``.
    joined = texts.join(wanted, KEY).select(*KEY, "bytes", "wanted").mapInArrow(cut, CUT_SCHEMA)
    return joined.dropDuplicates(["gram", "run"])


CUT_SCHEMA = "id long, digest long, start int, n int, off int, gram long, run long, copies long, bytes binary"
CUT = pa.schema([
    ("id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("off", pa.int32()),
    ("gram", pa.int64()), ("run", pa.int64()), ("copies", pa.int64()), ("bytes", pa.binary()),
])


BLOCKS = ("id long, digest long, place int, n int, gram long, run long, copies long, block int, core long, whole long")


def _blocks(members: DataFrame, length: int, gram: int) -> DataFrame:
    """The blocks of each run: place and number of suffixes, and hashes of the bytes that its suffixes share
    (``core``) and of all their bytes (``whole``)."""
    farthest = length - gram
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
             pa.int64(), pa.int64())
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for i, d, g, r, c, start, n, off, raw in zip(*[col.to_pylist() for col in batch.columns]):
                for j in range((off - n + 1) // BLOCK, off // BLOCK + 1):
                    core = digest(raw[off - BLOCK * j:off - min(BLOCK * j + BLOCK - 1, farthest) + length])
                    near, far = max(BLOCK * j, off - n + 1), min(BLOCK * j + BLOCK - 1, off)
                    whole = digest(raw[off - far:off - near + length], near * 4096 + far)
                    rows.append((i, d, start + off - far, far - near + 1, g, r, c, j, core - (1 << 63), whole - (1 << 63)))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)

    narrow = members.select(*KEY, "gram", "run", "copies", "start", "n", "off", "bytes")
    return narrow.mapInArrow(of_batches, BLOCKS)


def _suffixes(members: DataFrame, length: int) -> DataFrame:
    """(id, digest, place, copies, gram, back, whole): single suffixes of the blocks that are asked for."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, d, start, n, off, g, c, raw, blocks in zip(*[col.to_pylist() for col in batch.columns]):
                for j in blocks:
                    for back in range(max(BLOCK * j, off - n + 1), min(BLOCK * j + BLOCK - 1, off) + 1):
                        p = off - back
                        whole = xxhash.xxh3_64_intdigest(raw[p:p + length])
                        rows.append((i, d, start + p, c, g, back, whole - (1 << 63)))
            cols = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)],
                                             ["id", "digest", "place", "copies", "gram", "back", "whole"])

    narrow = members.select(*KEY, "start", "n", "off", "gram", "copies", "bytes", "blocks")
    return narrow.mapInArrow(
        of_batches, "id long, digest long, place int, copies long, gram long, back int, whole long")


def _spans(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, digest, lo, hi): byte ranges covered by repeated windows; they may overlap."""
    all_runs = written(runs(texts, length, gram), "runs")
    groups = all_runs.groupBy("gram").agg(
        F.count(F.lit(1)).alias("members"), F.min("run").alias("least"), F.max("run").alias("most")
    ).where("members > 1")
    met = written(spread_join(all_runs, groups.select("gram", (F.col("least") == F.col("most")).alias("same")), "gram"),
                  "met")
    whole = met.where("same")
    mixed = met.where("not same")
    classes = mixed.groupBy("gram", "run").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(*KEY, "start", "n", "off")).alias("one")
    ).select("gram", "run", "copies", "one.*")
    copied = classes.where("copies > 1").select("gram", "run")
    again = spread_join(mixed, copied, ["gram", "run"])
    cut = written(_with_bytes(texts, classes, length), "cut")
    blocks = written(_blocks(cut, length, gram), "blocks")
    # A block is settled if it meets no different run, or only runs that repeat as a whole, or only equal blocks.
    cores = blocks.groupBy("gram", "block", "core").agg(
        F.count(F.lit(1)).alias("runs"), F.min("copies").alias("fewest"), F.min("whole").alias("least"),
        F.max("whole").alias("most")
    ).where("runs > 1 and fewest = 1").select("gram", "block", "core", (F.col("least") == F.col("most")).alias("same"))
    shared = written(spread_join(blocks.drop("whole"), cores, ["gram", "block", "core"]), "shared")
    level = shared.where("same and copies = 1").select(*KEY, F.col("place").alias("start"), "n")
    open_blocks = shared.where("not same").groupBy("gram", "run").agg(F.collect_list("block").alias("blocks"))
    suffixes = written(_suffixes(cut.join(open_blocks, ["gram", "run"]), length), "suffixes")
    equal = suffixes.groupBy("gram", "back", "whole").agg(F.sum("copies").alias("places")).where("places > 1")
    single = spread_join(suffixes.where("copies = 1"), equal.drop("places"), ["gram", "back", "whole"])
    hit = whole.select(*KEY, "start", "n").unionByName(again.select(*KEY, "start", "n")).unionByName(
        level).unionByName(single.select(*KEY, F.col("place").alias("start"), F.lit(1).alias("n")))
    return hit.select(*KEY, F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1 + length).alias("hi"))


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges covered by ranges (lo, hi) that are in order of lo."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    first = np.concatenate(([True], lo[1:] > reach[:-1]))
    return lo[first], reach[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(lo) - 1]))]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte ranges, and the bytes that stay, in order."""
    if length < 2 * gram:
        gram = max(1, length // 2)
    texts = keyed(docs, id_col, text_col)
    spans = written(_spans(texts, length, gram).dropDuplicates(), "spans")
    per_text = spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_key(id_col, text_col), _bytes(text_col))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            sizes, counts, merged, kept = [], [], [], []
            for text, lo, hi in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = text.as_py()
                sizes.append(len(raw))
                if not lo.is_valid:
                    counts.append(0)
                    kept.append(raw)
                    continue
                gone = merge(lo.values.to_numpy(), hi.values.to_numpy())
                counts.append(len(gone[0]))
                merged.append(gone)
                cuts = [0, *np.stack(gone, 1).ravel().tolist(), len(raw)]
                kept.append(b"".join([raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])]))
            ends = [np.concatenate([m[k] for m in merged]) if merged else np.zeros(0, np.int32) for k in (0, 1)]
            ranges = pa.StructArray.from_arrays([pa.array(e.astype(np.int32)) for e in ends], ["lo", "hi"])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, ranges).cast(span),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    joined = asked.join(per_text, KEY, "left").select("doc_id", "bytes", "spans.lo", "spans.hi")
    return joined.mapInArrow(drop, "doc_id long, n_bytes long, spans array<struct<lo:int,hi:int>>, kept binary")
