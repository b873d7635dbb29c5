"""Connected components by alternating large-star and small-star rounds over a contracted graph.

First each partition joins what its own edges connect and sends one row a node, so that
what enters the rounds depends on nodes, not on edges.  Every round then points nodes at the
smallest id they know and rewires edges to it; the number of rounds is logarithmic in
practice, whatever the diameter.  Hub nodes are safe: the minimum over neighbours is a
partial aggregate, and rows are joined, never gathered.  Lineage is cut by tables in the
shared scratch folder.  Rounds and their edges are logged.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.session import forget, save, ship

HELD_EDGES = 1 << 20  # that a task contracts at a time
log = logging.getLogger(__name__)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the smallest id reachable.

    Loops keep their node; null ends are left out; directions and repeats don't matter.
    """
    forest = save(contracted(edges, src, dst), "component-forest")
    nodes = forest.select(F.col("u").alias("node")).distinct()
    state, before, rounds = forest.where("u <> v"), None, 0
    while True:
        wide = save(small_star(large_star(state)), "component-edges")
        after = wide.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state is not forest:
            forget(state)
        state, rounds = wide, rounds + 1
        log.info("components: %d edges after round %d", after[0], rounds)
        if after == before:
            break
        before = after
    return nodes.join(state, nodes.node == state.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (u, v): every node of a partition's edges and the smallest one that they join it with there, once each."""
    pairs = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    kind = pairs.select(F.coalesce(src, dst).alias("u")).schema["u"].dataType
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, of = [], 0, None
        for batch in batches:
            of = batch.column(0).type
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            waiting += batch.num_rows
            if waiting >= HELD_EDGES:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                waiting = 0
        if of is not None:
            u, v = stars(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u, of), pa.array(v, of)], ["u", "v"])

    both = pairs.select(F.col(src).cast(kind).alias("u"), F.col(dst).cast(kind).alias("v"))
    return both.mapInArrow(run, f"u {kind.simpleString()}, v {kind.simpleString()}")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (u, v) and the smallest node it is connected with."""
    if not len(u):
        return u, v
    ids, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, ids[least_reachable(both[: len(u)], both[len(u) :], len(ids))]


def least_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the smallest one connected with it: roots hook to smaller roots, then pointers jump."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of node and neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    linked = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
