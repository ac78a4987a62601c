"""Near copies by the Jaccard similarity of their five-word shingles, 0.8 or more.

Each distinct set of shingles gets ``BANDS`` keys, each a hash of ``ROWS`` minima of independent hash functions over the
set. Sets of similarity s agree in a key with a chance of 1 - (1 - s^7)^32: 0.9995 at 0.8, above 0.99999 at 0.85. Pairs
with a common key are settled exactly, and only pairs verified on their sets link.

The pairs of a key are not listed. Every key has one hub, a set that shares most keys with others (the original of
many copies; it need not be a member), and each member is compared with the hub alone. Members that link to the hub are in one class. If y does
not link to the hub, another member x can only link to y if both differ from the hub in the same shingles: with n
shingles in the hub, those of the hub that a set lacks counted 5, those it has beside them counted 4, and w the sum, a
similarity of 0.8 asks for (w_x + w_y - n) / 9 shared differences at least, and w_y > n. So members of a key get new
keys, the hub with each of their differences, of which only a prefix is needed: of d differences, t of which have to be
shared, the first d - t + 1 in an order that puts what a set has beside the hub, its own edits, first, and what it lacks,
which independent edits have in common by chance, last. Members of a new key meet only if one of them does not link to the hub,
they are in different classes, and their numbers of differences allow the shared ones that are asked for; where the key is
a shingle of the hub, those that they lack alone have to, as else they meet in one that both have. They are verified on their sets.

Defined results: words are split at ASCII white space, A-Z lower-cased. Fewer than five words are one shingle. Null texts,
and texts without words, have equal (empty) sets. Sets and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwright.operators.components import connected_components
from reelwright.operators.grouping import spread_join
from reelwright.session import written

WIDTH = 5
LEAST = (4, 5)  # the similarity from which pairs link, as a fraction
BANDS, ROWS = 32, 7
SEED = 42  # of the shingle hash
SHINGLES_AT_ONCE = 1024
HUB_STEP = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(7)
STEP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
START = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = text.lower().split()  # of bytes: A-Z, and white space 0x20 and 0x09 to 0x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WIDTH + 1)
    spans = zip(starts[:n].tolist(), ends[min(WIDTH, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n))


def set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function, in rows of a band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        x = found[at:at + SHINGLES_AT_ONCE, None] * STEP[None, :] + START[None, :]
        np.minimum(least, x.min(0), out=least)
    return least.reshape(BANDS, ROWS)


def band_keys(found: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    rows = minima(found) if rows is None else rows
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets reaches LEAST."""
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


def differences(hub: np.ndarray, found: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """How many shingles a set lacks and has beside a hub, and the differences, those beside it and those it lacks, of
    which it shares one with every set that it links to, if one of both does not link to the hub."""
    p, q = LEAST
    gone, new = np.setdiff1d(hub, found, assume_unique=True), np.setdiff1d(found, hub, assume_unique=True)
    weight, far = q * len(gone) + p * len(new), (q - p) * len(hub)
    # Another set than the hub weighs p at least.
    shared = weight // (p + q) + 1 if weight <= far else max(1, -(-(weight - far + p) // (p + q)))
    kept = max(0, len(gone) + len(new) - shared + 1)
    return len(gone), len(new), new[:kept], gone[:max(0, kept - len(new))]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py() or b"") for t in batch.column(2)]
        columns = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "key", "set", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py() or b"").astype("<u8").tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["set", "hashes"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for hub_id, several, hub, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            hub = np.frombuffer(hub.as_buffer(), "<u8")
            lacks, beside, *unlike = differences(hub, np.frombuffer(found.as_buffer(), "<u8"))
            own = np.uint64(hub_id * HUB_STEP & (1 << 64) - 1)
            rows.append((len(hub), lacks, beside, *((x[:len(x) if several else 0] ^ own).view(np.int64) for x in unlike)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                                         ["a", "b", "n", "lacks", "beside", "beside_keys", "lacks_keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x.as_buffer(), "<u8") for x in c] for c in batch.columns[2:4])
        kept = pa.array([linked(x, y) for x, y in zip(a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["src", "dst"])


def _both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with both sets. The side that may be hot, a, is joined last."""
    a, b = (sets.select(F.col("set").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    return spread_join(spread_join(pairs, b, "b"), a, "a")


def _compare(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Each member b of a key with the key's hub a: the hub's size n, how many shingles b lacks and has beside it, and b's
    new keys if the key has further members."""
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    sized = spread_join(members, sizes, "band")
    weights = sized.groupBy("set").agg(F.sum("n").alias("weight"))
    weighed = spread_join(sized, weights, "set")
    # A key without the original takes the hub of a key that one of its members is in, too.
    own = weighed.groupBy("band").agg(F.max(F.struct("weight", "set")).alias("own"))
    beside = spread_join(weighed, own, "band").groupBy("set").agg(F.max("own").alias("best"))
    hubs = spread_join(weighed, beside, "set").groupBy("band").agg(F.max("best").alias("hub"))
    several = (F.col("n") > 2) | (F.col("own.set") != F.col("hub.set"))
    keyed = spread_join(weighed, own.join(hubs, "band"), "band")
    pairs = keyed.where(F.col("set") != F.col("hub.set")).groupBy(F.col("hub.set").alias("a"), F.col("set").alias("b")).agg(
        F.bool_or(several).alias("several"))
    both = _both(written(pairs, "pairs"), sets).select("a", "b", "several", "hashes_a", "hashes_b")
    return written(both.mapInArrow(_compared, "a long, b long, n long, lacks long, beside long, beside_keys array<long>, lacks_keys array<long>"), "compared")


def _meetings(compared: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): pairs of members that may link though one of them does not link to their hub."""
    p, q = LEAST
    rows = spread_join(compared.withColumnRenamed("b", "set"), labels, "set", "left").select(
        "set", "n", "lacks", "beside", F.coalesce("label", "set").alias("label"),
        (q * F.col("lacks") + p * F.col("beside")).alias("weight"), "beside_keys", "lacks_keys")
    keys = [F.expr(f"transform({kind}_keys, k -> struct(k AS band, {own} AS own))") for kind, own in (("beside", "true"), ("lacks", "false"))]
    rows = rows.select("set", "n", "lacks", "beside", "label", "weight", F.explode(F.concat(*keys)).alias("k")).select("*", "k.*").drop("k")
    far = F.col("weight") > (q - p) * F.col("n")
    # Keys of several classes, one of whose members does not link to the hub.
    open_keys = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or(far).alias("any")).where("lo < hi and any")
    rows = written(spread_join(rows, open_keys.select("band"), "band"), "differences")
    spread = F.xxhash64("band")
    x, y = rows.withColumn("_s", spread).alias("x"), rows.where(far).withColumn("_s", spread).alias("y")
    asked = F.expr(f"x.weight + y.weight - {q - p} * x.n")
    most = F.expr("least(x.lacks, y.lacks) + if(x.own, least(x.beside, y.beside), 0)")
    once = F.expr(f"x.weight <= {q - p} * x.n or x.`set` < y.`set`")  # of two that do not link to the hub
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x._s") == F.col("y._s")) & (F.col("x.label") != F.col("y.label"))
                 & once & ((p + q) * most >= asked))
    return written(met.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct(), "meetings")


def _labels(links: DataFrame) -> DataFrame:
    found = connected_components(links.distinct())
    return written(found.select(F.col("item_id").alias("set"), F.col("component").alias("label")), "labels")


def classes(docs: DataFrame, key: str = "_key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, label): one row per row of ``docs``, with its class. Rows of equal ``key`` must have equal texts."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{key}`").alias("key"),
                         F.col(f"`{text_col}`").cast("binary").alias("text"))
    marked = written(narrow.mapInArrow(_marked, "doc_id long, key long, set long, bands array<long>"), "sets")
    distinct = marked.groupBy("set").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    members = distinct.select(F.explode("bands").alias("band"), "set")
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = written(spread_join(members, shared, "band"), "members")
    met = distinct.select("set", "key").join(members.select("set").distinct(), "set")
    texts = spread_join(narrow.select("key", "text"), met, "key").groupBy("set").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_sets, "set long, hashes binary"), "hashes")
    compared = _compare(members, sets)
    p, q = LEAST
    near = compared.where(q * F.col("lacks") + p * F.col("beside") <= (q - p) * F.col("n"))
    links = near.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = _both(_meetings(compared, _labels(links)), sets).select("a", "b", "hashes_a", "hashes_b")
    links = links.unionByName(written(found.mapInArrow(_verified, "src long, dst long"), "links"))
    labels = _labels(links)
    return spread_join(marked.select("doc_id", "key", "set"), labels, "set", "left").select(
        "doc_id", "key", F.coalesce("label", "set").alias("label"))


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies: the one with the least id, null ids last.

    Among rows of that id, the text with the least hash stays; of rows equal in both, the least. Columns may have any names.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id"), F.col("text"), own.alias("row"))
    keyed = rows.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    kept = classes(keyed, "key").groupBy("label").agg(F.min_by("key", order).alias("key"))
    other = F.to_json(F.struct(*[F.col("row").getField(c) for c in docs.columns if c != "text"]))
    first = keyed.join(kept.select("key"), "key", "left_semi").groupBy("key").agg(F.min_by("row", other).alias("row"))
    return first.select("row.*")
