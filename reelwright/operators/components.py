"""Connected components by contraction in tasks and large-star steps between them.

A round has two steps. Contraction: every task joins the edges it holds in memory and sends on a spanning forest, each
node with the least node of its tree, then does the same with all edges of the nodes that are dealt to it. So what a task
can settle alone never becomes traffic, and a node sends one edge a task at most, however many edges it has. Large-star
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): every larger neighbour of a node moves to the least
label around it, a grouped minimum that combines before the shuffle plus a join back whose hot labels can be split.

Contraction by node does all that a small-star step does, so O(log^2 n) rounds suffice, and two or three are usual.
The search ends with the round in which large-star moves nothing, which it counts while it is written, and no node has two labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reelwright.operators.grouping import spread_join
from reelwright.session import cut_lineage

EDGES_AT_ONCE = 2_000_000  # that a task holds in memory; more are joined chunk by chunk


def forest(pairs: Iterator[tuple]) -> dict:
    """Each node of the pairs that is not the least of its tree, with the least node of its tree, one pair at a time.

    Tasks do the same on arrays (``_contracted``).
    """
    parent: dict = {}

    def root(x):
        above = parent.get(x, x)
        while above != x:
            higher = parent.get(above, above)
            if higher != above:
                parent[x] = higher
            x, above = above, higher
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least number of its tree for each of the numbers below ``n``, joined by the pairs (u, v).

    Roots hang on the least root next to them, then all paths are cut to one step, until no pair has two roots.
    """
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, above := label[label]):
            label = above
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sent(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        nodes = ends.dictionary.take(order)
        place = np.empty(len(nodes), np.int64)
        place[order.to_numpy()] = np.arange(len(nodes))
        u, v = np.split(place[ends.indices.to_numpy()], 2)
        label = least_labels(u, v, len(nodes))
        led = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(led)), nodes.take(pa.array(label[led]))], ["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= EDGES_AT_ONCE:
            yield sent(held)
            held, size = [], 0
    if size:
        yield sent(held)


def contract(edges: DataFrame) -> DataFrame:
    """(u, v), v the least node that a task knows to be connected with u: within tasks, then among all edges of a node."""
    kind = edges.schema["u"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    return edges.select("u", "v").mapInArrow(_contracted, schema).repartition("u").mapInArrow(_contracted, schema)


def _large_star(edges: DataFrame) -> tuple[DataFrame, int]:
    """Every larger neighbour of a node moves to the least label around the node; how many moved.

    The least label around a node is its least smaller neighbour, or the node itself where it has none.
    """
    lowest = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    joined = spread_join(edges, lowest, "v", "left")
    least = F.coalesce("m", "v")
    rows = joined.select("u", least.alias("v"), (least != F.col("v")).alias("moved"))
    seen = Observation()
    done = cut_lineage(rows.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("moved")).drop("moved"))
    return done, seen.get["moved"]


def _labels(edges: DataFrame) -> tuple[DataFrame, int]:
    """The least label of every node; how many nodes have several."""
    ends = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    seen = Observation()
    several = F.count(F.when(F.col("v") != F.col("last"), 1)).alias("several")
    return cut_lineage(ends.observe(seen, several).drop("last")), seen.get["several"]


def connected_components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(item_id, component) for every node of ``edges`` (src, dst); the label is the least id.

    ``known`` (item_id, component) are labels of an earlier run, all of whose edges still hold: edges that came since
    are enough then. Null ends link nothing.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    if known is not None:
        pairs = pairs.union(known.select(F.greatest("item_id", "component"), F.least("item_id", "component")))
    current, settled = pairs.where("u <> v"), False
    while not settled:
        current, moved = _large_star(cut_lineage(contract(current)))
        if not moved:
            labels, several = _labels(current)
            settled = not several
    roots = labels.select(F.col("v").alias("item_id")).distinct()
    return labels.select(F.col("u").alias("item_id"), F.col("v").alias("component")).unionByName(
        roots.select("item_id", F.col("item_id").alias("component"))
    )
