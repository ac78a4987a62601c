"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end; the line of words is cut into
blocks of ``block`` words (the last one is shorter). The mix is a row of slots. Slot i has the
golden-ratio point frac((i + 1/2) * phi), and the cumulated targets map the point to a source, so
that every stretch of the mix holds the sources in proportion. Slots are ranked per source, and the
r-th slot of a source takes its block number r in an order that is shuffled anew for each pass over
the source. A document's words are taken as often as their blocks are.

Targets follow the weights, but stop at ``most`` times the size of their source; what is over is
shared again by weight among the rest until no target is above. This is the level L at which the
sums of min(most * size, L * weight) make up the mix, found from the sources in order of most * size
/ weight.

Schedules stay exact under the stop: the points make up each source's number of slots to within a
few, and a source is given no more slots than ``most`` passes hold. Sources are few, as weights are
given for them one by one: one row per source reaches the driver. Ranks of slots come from counts
per stretch of slots; nothing is sorted in one task.

Defined results: null and empty texts have size 0 and are taken 0 times. A null source is a source
of its own, last in order. Sources of size 0 get target 0. Repeated rows, repeated and null doc_ids
each keep their row. An empty table gives an empty mix. ``mix`` reads no other columns. Reruns agree:
documents are ordered by a hash of id and text, and equal rows are interchangeable only as their
results over all equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.ordering import with_starts
from reelwright.operators.grouping import spread_join
from reelwright.session import written

BLOCK = 256
STRETCH = 1 << 14  # slots that are ranked together
#: The golden ratio's fraction in units of 2^-52.
PHI = 2783283543880249
MODULUS = 1 << 52
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SPACE = r"[^\x20\x09-\x0D]+"
WORDS = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Source:
    """A source, its total size, its target and its number of slots."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int = 0


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size."""
    left, weight = total, float(sum(weights))
    out = [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i)):
        out[i] = min(most * sizes[i], left * weights[i] / weight) if weight > 0 else 0.0
        left -= out[i]
        weight -= weights[i]
    return out


def plan(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
         most: float = MOST, block: int = BLOCK) -> list[Source]:
    """Sources by code point, null last, with targets; ``weights`` repeat in that order."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    own = [weights[i % len(weights)] for i in range(len(ordered))]
    total = share * sum(n for _, n in ordered)
    found = targets([n for _, n in ordered], own, total, most) if ordered else []
    return [Source(name, n, t, -(-n // block)) for (name, n), t in zip(ordered, found)]


def _schedule(sources: list[Source], block: int) -> tuple[list[Source], list[float]]:
    """Slots per source, and the cumulated shares that the points are mapped through.

    A slot holds a block's mean size, so that a short last block takes no words from the target.
    """
    want = [min(s.target / (s.size / s.blocks), MOST * s.blocks) if s.size else 0.0 for s in sources]
    slots = [int(round(w)) for w in want]
    total = sum(slots)
    edges = np.cumsum(slots) / total if total else np.zeros(len(slots))
    return [Source(s.name, s.size, s.target, s.blocks, n) for s, n in zip(sources, slots)], edges.tolist()


def schedule(spark, sources: list[Source], block: int = BLOCK) -> DataFrame:
    """(slot, source, rank): the mix as a row of slots; rank counts a source's slots from 0.

    Points of a source beyond its number of slots are passed over, and slots are added until each
    source has its number: a few per source.
    """
    sources, edges = _schedule(sources, block)
    total = sum(s.slots for s in sources)
    if not total:
        return spark.createDataFrame([], "slot long, source int, rank long")
    # The discrepancy of golden-ratio points is below this many slots per source.
    spare = 4 * (total.bit_length() + 4) * len(sources)
    n = total + spare
    # i * phi modulo 1 in whole numbers: 26 bits at a time, as products must fit 64 bits.
    low, high = PHI & ((1 << 26) - 1), PHI >> 26
    i = F.col("slot")
    i_low, i_high = i.bitwiseAND(F.lit((1 << 26) - 1)), F.shiftrightunsigned(i, 26).bitwiseAND(F.lit((1 << 26) - 1))
    middle = (i_low * F.lit(high)).bitwiseAND(F.lit(MODULUS - 1)) + (i_high * F.lit(low)).bitwiseAND(F.lit(MODULUS - 1))
    point = i_low * F.lit(low) + middle.bitwiseAND(F.lit((1 << 26) - 1)) * F.lit(1 << 26) + F.lit(PHI // 2)
    x = point.bitwiseAND(F.lit(MODULUS - 1)).cast("double") / F.lit(float(MODULUS))
    steps = F.array(*[F.lit(float(e)) for e in edges])
    source = F.least(F.size(F.filter(steps, lambda e: e <= x)), F.lit(_last(sources)))
    slots = spark.range(n).select(F.col("id").alias("slot")).select("slot", source.alias("source"))
    slots = slots.withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    counts = slots.groupBy("stretch", "source").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("stretch", "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("stretch", "source").orderBy("slot")
    ranked = slots.withColumn("local", F.row_number().over(inside) - 1).join(bases, ["stretch", "source"])
    limit = F.array(*[F.lit(s.slots).cast("long") for s in sources])[F.col("source")]
    kept = ranked.select("slot", "source", (F.col("base") + F.col("local")).alias("rank")).where(F.col("rank") < limit)
    return kept


def _last(sources: list[Source]) -> int:
    return max(i for i, s in enumerate(sources) if s.slots)


def _order(blocks: int, epoch: int) -> tuple[int, int]:
    """Step and start of a pass over a source's blocks: r -> (step * r + start) mod blocks."""
    step = max(1, int(blocks * (0.381966 + 0.1 * epoch)) | 1)
    while np.gcd(step, blocks) != 1:
        step += 1
    return step % blocks if blocks > 1 else 0, (blocks * (epoch + 1)) // 3


def _placed(docs: DataFrame, key: Column, weights: Sequence[float], share: float, most: float, block: int, id_col: str,
            text_col: str, source_col: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(doc_id, source, size, key, number, start): documents on their source's line; what is known of each source;
    (number, key, start, block, words, times): how often the mix takes each document's part of each block."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE)), F.lit(0)).cast("long")
    # The text is hashed and counted in the first pass; only narrow rows move.
    narrow = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "sizes")
    per_source = [(r.source, r.n) for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    sources = plan(per_source, weights, share, most, block)
    sources, _ = _schedule(sources, block)
    if not sources:
        return narrow, None, None
    known = spark.createDataFrame(
        [(s.name, i, s.size, s.target, s.blocks, *_order(max(1, s.blocks), 0), *_order(max(1, s.blocks), 1))
         for i, s in enumerate(sources)],
        "name string, number int, source_size long, target double, blocks long, "
        "step0 long, start0 long, step1 long, start1 long")
    numbered = narrow.join(F.broadcast(known.select("name", "number")), F.col("source").eqNullSafe(F.col("name")))
    placed = with_starts(numbered.drop("name"), ["number", "key"], "size", ["number"])
    # Kept: each document's place on its source's line.
    placed = written(placed, "places")
    pieces = placed.where("size > 0").select(
        "number", "key", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
        .alias("block"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(
        F.col("start"), F.col("block") * block)
    pieces = pieces.select("number", "key", "start", "block", words.alias("words"))
    slots = schedule(spark, sources, block).join(
        F.broadcast(known.drop("name", "source_size", "target")), F.col("source") == F.col("number"))
    epoch = F.floor(F.col("rank") / F.col("blocks"))
    r = F.col("rank") % F.col("blocks")
    step = F.when(epoch % 2 == 0, F.col("step0")).otherwise(F.col("step1"))
    start = F.when(epoch % 2 == 0, F.col("start0")).otherwise(F.col("start1"))
    # The product stays exact: step and r are below 2^31 for up to 2^39 words in a source.
    taken_blocks = slots.select("number", ((step * r + start) % F.col("blocks")).alias("block")).groupBy(
        "number", "block").agg(F.count(F.lit(1)).alias("times"))
    return placed, known, pieces.join(taken_blocks, ["number", "block"])


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
        block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken): every document with the words the mix takes of it.

    ``key`` is a hash of id, text and source.
    """
    key = F.xxhash64(F.col(id_col).isNull(), id_col, text_col, F.col(source_col).isNull(), source_col)
    placed, known, pieces = _placed(docs, key, weights, share, most, block, id_col, text_col, source_col)
    if known is None:
        return placed.select("doc_id", "key", "source", "size", F.lit(0).cast("long").alias("source_size"),
                             F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    taken = pieces.groupBy("number", "key", "start").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    totals = F.broadcast(known.select("number", "source_size", "target"))
    # Documents of size 0 share their start with the next one, so size is part of the match.
    sized = taken.withColumn("some", F.lit(True))
    joined = placed.withColumn("some", F.col("size") > 0).join(sized, ["number", "key", "start", "some"], "left")
    return joined.join(totals, "number").select(
        "doc_id", "key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
                    block: int = BLOCK) -> DataFrame:
    """The words that the mix takes, as rows of documents; sizeless documents once.

    Neighbouring blocks of a document that are taken in the same pass make one row, whose text is that part of the
    document with its white space; a document that is taken whole is one row with its own text. Other columns are
    the document's.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    rest = [F.to_json(F.struct(*others))] if others else []
    # Rows of equal keys are equal in all columns, so any of them can stand for the others.
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text", F.col("source").isNull(), "source", *rest)
    placed, known, pieces = _placed(docs, key, weights, share, most, block, "doc_id", "text", "source")
    if known is None:
        return docs.limit(0)
    one = ["number", "key", "start"]
    passes = pieces.select(*one, "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("pass"))
    in_pass = Window.partitionBy(*one, "pass").orderBy("block")
    runs = passes.withColumn("run", F.col("block") - F.row_number().over(in_pass)).groupBy(*one, "pass", "run").agg(
        (F.min("block") * block).alias("lo"), ((F.max("block") + 1) * block).alias("hi"))
    taken = runs.groupBy(*one).agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    sized = placed.where("size > 0").select(*one, "size").join(taken, one)
    lo, hi = (lambda r: F.greatest(r["lo"] - F.col("start"), F.lit(0))), (
        lambda r: F.least(r["hi"] - F.col("start"), F.col("size")))
    cut = F.transform("runs", lambda r: F.struct(lo(r).alias("at"), (hi(r) - lo(r)).alias("n")))
    none = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n")))
    parts = sized.select(F.col("key").alias("_key"), F.col("size").alias("_size"), cut.alias("_parts")).unionByName(
        placed.where("size = 0").select(F.col("key").alias("_key"), F.col("size").alias("_size"), none.alias("_parts")))
    rows = docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row")).groupBy("_key").agg(
        F.first("_row").alias("_row"))
    found = spread_join(parts, rows, "_key")
    # Words with the white space after them; the first also with that before it. Found once a document.
    words = F.when(F.exists("_parts", lambda p: p["n"] < F.col("_size")),
                   F.regexp_extract_all(F.col("_row")["text"], F.lit(WORDS), F.lit(0)))
    texts = F.transform(F.array(words), lambda w: F.transform("_parts", lambda p: F.when(
        p["n"] == F.col("_size"), F.col("_row")["text"]).otherwise(
        F.array_join(F.slice(w, (p["at"] + 1).cast("int"), p["n"].cast("int")), ""))))[0]
    emitted = found.select("_row", F.explode(texts).alias("_text"))
    return emitted.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
