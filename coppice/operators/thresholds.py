"""Groups at every similarity, from one edge list.

A maximum spanning forest by similarity connects at every threshold what all edges
connect, and has fewer edges than records.  Once it is there, groups at any threshold
not below the edges' own are components of a part of it: nothing is joined again.

The forest is found in Boruvka's rounds: every group takes its strongest edge to
another one, and what these edges connect is a group of the next round, so groups halve
at least.  Edges are ordered by similarity, then by their rows, so no two are equal and
no cycle can close.  Before the rounds each partition keeps only the strongest edges that
connect its own nodes; an edge that closes a cycle of stronger ones is in no forest.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.operators.components import connected_components
from coppice.operators.records import ROW
from coppice.session import forget, save, ship

HELD_EDGES = 1 << 20
FOREST = "src long, dst long, percent int"
log = logging.getLogger(__name__)


def with_percent(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, percent): the similarity in whole percent, as thresholds are."""
    union = F.col("n_src") + F.col("n_dst") - F.col("shared")
    return edges.select("src", "dst", F.floor(100 * F.col("shared") / union).cast("int").alias("percent"))


def strongest(src: np.ndarray, dst: np.ndarray, percent: np.ndarray) -> np.ndarray:
    """Places of a maximum spanning forest's edges, by the same rounds inside a task."""
    ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    order = np.lexsort((dst, src, -percent))
    a, b = both[: len(src)][order], both[len(src) :][order]
    group, left, taken = np.arange(len(ids)), np.arange(len(order)), []
    while True:
        x, y = group[a[left]], group[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            return order[np.sort(np.concatenate(taken))] if taken else np.zeros(0, np.int64)
        best = np.full(len(ids), len(order))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        chosen = np.unique(best[best < len(order)])
        taken.append(chosen)
        group = merged(group, a[chosen], b[chosen])


def merged(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups after the edges (a, b) joined some of them; a group is named by its smallest node."""
    while True:
        x, y = group[a], group[b]
        if (x == y).all():
            return group
        np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
        while (group[group] != group).any():
            group = group[group]


def strongest_of_parts(edges: DataFrame) -> DataFrame:
    """At most one edge less than nodes from every partition."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.table(batch.columns, batch.schema.names)
            held = new if held is None else pa.concat_tables([held, new.cast(held.schema)])
            if held.num_rows >= HELD_EDGES:
                held = kept(held)
        if held is not None:
            yield from kept(held).combine_chunks().to_batches()

    def kept(table: pa.Table) -> pa.Table:
        return table.take(strongest(*(c.to_numpy() for c in table.columns)))

    return edges.select("src", "dst", "percent").mapInArrow(run, FOREST)


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Rows (src, dst, percent) of the maximum spanning forest of edges, which have no nulls; repeats and loops are left out."""
    both = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "percent")
    state = save(strongest_of_parts(both).withColumns({"a": F.col("src"), "b": F.col("dst")}), "forest-edges")
    taken, rounds = [], 0
    while not state.isEmpty():
        ends = state.unionByName(state.withColumns({"a": F.col("b"), "b": F.col("a")}))
        order = F.struct(-F.col("percent"), "src", "dst")
        best = ends.groupBy("a").agg(F.min_by(F.struct("src", "dst", "percent", "b"), order).alias("e"))
        chosen = save(best.select("a", "e.*"), "forest-chosen")
        taken.append(chosen.select("src", "dst", "percent"))
        groups = connected_components(chosen, "a", "b")
        named = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
        moved = state.join(named("a"), "a").join(named("b"), "b").where("_a <> _b")
        after = save(moved.select("src", "dst", "percent", F.col("_a").alias("a"), F.col("_b").alias("b")), "forest-edges")
        forget(state)
        state, rounds = after, rounds + 1
        log.info("forest: round %d", rounds)
    if not taken:
        return edges.sparkSession.createDataFrame([], FOREST)
    return save(reduce(DataFrame.unionByName, taken).distinct(), "forest")


def groups_at(records: DataFrame, forest: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Rows (threshold, row_index, component) of every record at each threshold, alone where nothing is as similar."""
    parts = []
    for t in thresholds:
        found = connected_components(forest.where(F.col("percent") >= t))
        joined = records.select(ROW).join(found.withColumnRenamed("node", ROW), ROW, "left")
        parts.append(joined.select(F.lit(t).alias("threshold"), ROW, F.coalesce("component", ROW).alias("component")))
    return reduce(DataFrame.unionByName, parts)
