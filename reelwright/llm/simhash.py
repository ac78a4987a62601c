"""SimHash near-duplicate classes found by deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints that differ in at most three bits differ in at most
one bit in one of their two halves. So each half is indexed 32 times, each time with another of
its bits wiped out: fingerprints that may link agree in one of these 64 signatures, and an
equality grouping on the signature finds them. Candidates are verified on all 64 bits.

Only distinct fingerprints are indexed, so exact copies cost nothing. A signature group emits a
spanning forest of its links, never its pairs; a group too large to compare pair by pair is cut
again by the same rule on its other half, which loses no link. Groups are linked to classes by
connected components.

Defined results: null and empty texts, and texts of white space alone, have no words and
fingerprint zero, which links like any other. Texts with fewer words than the shingle width have
one shingle, the whole sequence. Repeated rows and repeated ids each keep their row. A row with a
null id gets a fingerprint and a class, but gives the class no name; a class without any id has a
null name. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.operators.components import connected_components
from reelwright.operators.grouping import spread_join
from reelwright.session import written

MAX_DIFFERING = 3
SEED = 42  # of the shingle hash
HASHES_AT_ONCE = 1 << 16
#: Groups up to this size are compared pair by pair in one matrix.
MATRIX_ROWS = 2048


def fingerprint(text: bytes, width: int) -> int:
    """Bit j is set if it is set in more than half of the shingles' hashes."""
    words = text.lower().split()  # of bytes: A-Z, and white space 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        spans = zip(starts[at:at + HASHES_AT_ONCE], ends[at:at + HASHES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document; ``fp`` holds the 64 bits as a signed long."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(of_batches, "doc_id long, fp long")


def _signatures(fp: Column) -> Column:
    """The 64 signatures: number of the half, number of the wiped bit, the other 31 bits."""
    low = F.lit(0xFFFFFFFF)

    def one(i: Column) -> Column:
        bit = i % 32
        half = F.when(i < 32, fp.bitwiseAND(low)).otherwise(F.shiftrightunsigned(fp, 32))
        kept = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast(i % 32 as int))")))
        return kept + bit * F.lit(1 << 32) + F.when(i < 32, F.lit(0)).otherwise(F.lit(1 << 37))

    return one(F.col("i"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if np.array_equal(before, root):
            return root


def _pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints, reduced to a forest; rows against all, in blocks."""
    root = np.arange(len(fps))
    step = max(1, MATRIX_ROWS * MATRIX_ROWS // max(1, len(fps)))
    for at in range(0, len(fps), step):
        near = np.bitwise_count(fps[at:at + step, None] ^ fps[None, :]) <= MAX_DIFFERING
        a, b = np.nonzero(near)
        root = _roots(len(fps), np.concatenate((a + at, np.arange(len(fps)))), np.concatenate((b, root)))
    node = np.flatnonzero(root != np.arange(len(fps)))
    return node, root[node]


def group_links(fps: np.ndarray, other_half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one signature group. ``other_half``: the shift of the half the group does not share."""
    if len(fps) <= MATRIX_ROWS:
        return _pairs(fps)
    # Members differ in at most three bits of the other half, so in at most one of a quarter.
    found = []
    for quarter in (0, 16):
        part = (fps >> np.uint64(other_half + quarter)) & np.uint64(0xFFFF)
        for bit in range(16):
            key = part & np.uint64(~(1 << bit) & 0xFFFF)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for members in np.split(order, cuts):
                if len(members) > 1:
                    a, b = _pairs(fps[members])
                    found.append((members[a], members[b]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    root = _roots(len(fps), a, b)
    node = np.flatnonzero(root != np.arange(len(fps)))
    return node, root[node]


def _links_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by signature; each group is compared as a whole."""
    held_sig, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def out(sig: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.concatenate((first, [len(sig)])))
        two = first[size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_DIFFERING
        src, dst = [fp[two[near]]], [fp[two[near] + 1]]
        for at, n in zip(first[size > 2], size[size > 2]):
            members = fp[at:at + n]
            a, b = group_links(members, 0 if sig[at] >> 37 else 32)
            src.append(members[a])
            dst.append(members[b])
        columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)]
        return pa.RecordBatch.from_arrays(columns, ["src", "dst"])

    for batch in batches:
        sig = np.concatenate((held_sig, batch.column(0).to_numpy()))
        fp = np.concatenate((held_fp, batch.column(1).to_numpy().view(np.uint64)))
        last = int(np.searchsorted(sig, sig[-1])) if len(sig) else 0  # the last group may go on
        if last:
            yield out(sig[:last], fp[:last])
        held_sig, held_fp = sig[last:], fp[last:]
    if len(held_sig):
        yield out(held_sig, held_fp)


def links(fps: DataFrame) -> DataFrame:
    """(src, dst): a forest that joins all distinct ``fp`` within three bits of each other."""
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        _signatures(F.col("fp")).alias("sig"), "fp"
    )
    sorted_groups = variants.repartition("sig").sortWithinPartitions("sig")
    return sorted_groups.mapInArrow(_links_of_sorted, "src long, dst long").distinct()


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the class of each document, named by its least id."""
    marked = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(links(distinct.select("fp")))
    classes = distinct.join(
        labels.select(F.col("item_id").alias("fp"), F.col("component").alias("label")), "fp", "left"
    ).select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = spread_join(classes.select("fp", "label"), named, "label").select("fp", "component_id")
    return spread_join(marked, by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_class(docs: DataFrame, width: int = 3) -> DataFrame:
    """The documents whose id names their class, once each; rows without an id stay.

    Where a kept id occurs in several rows, the row with the least text (nulls first) stays.
    """
    named = near_duplicate_classes(docs, width=width).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(named, "doc_id", "left_semi")
    others = [c for c in docs.columns if c != "doc_id"]
    first = kept.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.struct("text", F.to_json(F.struct(*others)))).alias("row"))
    once = first.select("doc_id", *[F.col("row")[c].alias(c) for c in others]).select(*docs.columns)
    return once.unionByName(docs.where("doc_id is null"))
