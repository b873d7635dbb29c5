"""Jaccard edges between records over their valid terms.

Strategies with equal results.  ``overlap`` (default) orders the terms rare first and
keeps lists of the first terms of each record only, ordered by set size.  On a list,
two records are a candidate if their sizes allow the threshold and the term stands so
early in both that the terms after it can still make up the overlap that is needed, and
some more (``SLACK``, less for short records).  Tasks add up what a pair shares on their lists and deal the pairs, in compressed
columns, to tasks that add these up, and the pair goes on only if it shares more than so many of these first terms:
what it shares later could not reach the overlap without them.  Chance pairs share one
or two rare terms and end here.  The rest are compared in whole, in blocks that hold each
set once.  ``counts`` joins posting lists and counts shared terms a pair, in SQL's own terms.
``collapse`` joins one representative of equal term sets and attaches the others to it
(for components only).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.hashed import mix64
from coppice.functions.packing import firsts, from_binary, packed, sorted_within, spans, unpacked
from coppice.operators.features import LEAST_DF, MOST_DF, distinct_terms, valid_terms
from coppice.operators.records import ROW
from coppice.operators.termsets import saved_term_sets
from coppice.operators.termsets import term_sets as packed_term_sets
from coppice.session import forget, release, save, ship

SLACK = 16  # more of it: more pairs are met and fewer compared in whole
SLACK_SHARE = 16  # of the terms needed, one in so many at most: short records would have all their terms on lists
PART_ENTRIES = 1 << 19  # list entries of a task, about
MOST_MET = 1 << 22  # meetings that a task expands, and shared terms that it adds up, at a time
BLOCK_IDS = 1 << 21  # ids of the sets in one block of comparisons, about
LEADER_PAIRS = 1 << 17  # of one leader that are compared in one place, about
HELD_ENTRIES = 1 << 20  # list entries that a task packs at a time, about
PART_SCHEMA = "part int, ids binary, local binary, places binary, rows binary, sizes binary"
EDGE_SCHEMA = "src long, dst long, shared long, n_src long, n_dst long"


def kept_terms(records: DataFrame, keys: tuple[str, ...] = (), most_df: int = MOST_DF) -> DataFrame:
    """Rows (keys, row_index, term) of valid terms."""
    terms = save(distinct_terms(records, keys), "terms")
    return terms.join(valid_terms(terms, keys, most=most_df).select(*keys, "term"), [*keys, "term"], "left_semi")


def shared_counts(kept: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (src, dst, shared) for pairs with a common valid term, src < dst."""
    left = kept.select(*keys, "term", F.col(ROW).alias("src"))
    right = kept.select(*keys, "term", F.col(ROW).alias("dst"))
    met = left.join(right, [*keys, "term"]).where("src < dst")
    return met.groupBy("src", "dst").agg(F.count("*").alias("shared"))


def passes(shared, n_src, n_dst, percent: int):
    """floor(100 * shared / union) >= percent, in whole numbers; an empty union never passes."""
    union = n_src + n_dst - shared
    return (union > 0) & (100 * shared >= percent * union)


def edges_by_counts(records: DataFrame, percent: int, keys: tuple[str, ...] = (), most_df: int = MOST_DF) -> DataFrame:
    """Rows (src, dst, shared, n_src, n_dst)."""
    kept = save(kept_terms(records, keys, most_df), "kept-terms")
    sizes = kept.groupBy(ROW).agg(F.count("*").alias("n"))
    pairs = shared_counts(kept, keys)
    # an edge shares at least a hundredth of percent of its smaller set, so pairs with one shared term mostly end here
    return (
        pairs.join(sizes.select(F.col(ROW).alias("src"), F.col("n").alias("n_src")), "src")
        .join(sizes.select(F.col(ROW).alias("dst"), F.col("n").alias("n_dst")), "dst")
        .where(passes(F.col("shared"), F.col("n_src"), F.col("n_dst"), percent))
        .select("src", "dst", "shared", "n_src", "n_dst")
    )


def term_sets(records: DataFrame, keys: tuple[str, ...] = (), most_df: int = MOST_DF) -> DataFrame:
    """Rows (row_index, ids, n): sorted ids of valid terms, rare terms first, packed."""
    return packed_term_sets(records, keys, LEAST_DF, most_df)


def saved_sets(records: DataFrame, keys: tuple[str, ...] = (), most_df: int = MOST_DF, turns: int = 1) -> DataFrame:
    """``term_sets``, written; what was shuffled for them is given back."""
    return saved_term_sets(records, keys, LEAST_DF, most_df, turns)


def needed(n, m, percent: int):
    """Terms that sets of these sizes share at least if they pass."""
    return np.maximum(1, -(-percent * (n + m) // (100 + percent)))


def first_entries(rows: np.ndarray, ids: np.ndarray, n: np.ndarray, percent: int, slack: int) -> tuple[np.ndarray, ...]:
    """Columns (id, row, n, at) of the first terms of every set, those that a pair can be met on."""
    # a pair needs no more terms than its smaller set has, so this covers the slack of any pair
    first = n - np.maximum(1, -(-percent * n // 100)) + 1 + np.minimum(slack, n // SLACK_SHARE)
    many = np.clip(first, 0, n)
    places = spans(np.zeros(len(n), np.int64), many)
    return ids[np.repeat(firsts(n), many) + places], np.repeat(rows, many), np.repeat(n, many), places


def list_parts(sets: DataFrame, percent: int, slack: int, parts: int) -> DataFrame:
    """Rows (part, entries, ...): entries of the lists that are dealt to a part, in compressed columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64)
            held.append(first_entries(batch.column(0).to_numpy(), from_binary(batch.column(1), n), n, percent, slack))
            many += len(held[-1][0])
            if many >= HELD_ENTRIES:
                yield from out(held)
                held, many = [], 0
        if many:
            yield from out(held)

    def out(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, rows, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (mix64(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = sorted_within(part, ids)
        ids, rows, n, at, part = ids[order], rows[order], n[order], at[order], part[order]
        known, which = np.unique(rows, return_inverse=True)
        size = np.zeros(len(known), np.int64)
        size[which] = n
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            used, local = np.unique(which[a:b], return_inverse=True)
            columns = packed(np.diff(ids[a:b], prepend=0)), packed(local), packed(at[a:b]), packed(np.diff(known[used], prepend=0)), packed(size[used])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], [x.split()[0] for x in PART_SCHEMA.split(", ")])

    return sets.select(ROW, "ids", "n").mapInArrow(run, PART_SCHEMA)


def read_part(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (id, row, n, at) of each row of ``list_parts``."""
    for ids, local, at, rows, n in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
        local = unpacked(local)
        yield np.cumsum(unpacked(ids)), np.cumsum(unpacked(rows))[local], unpacked(n)[local], unpacked(at)


def met_on_lists(ids: np.ndarray, rows: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int, slack: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns (src, dst, more) of the meetings on whole lists, sorted by list and size; ``more`` is what a pair must exceed."""
    starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    which = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(ids)))
    # partners of an entry: those before it on its list, from the first that is large enough
    step = int(n.max()) + 1
    low = np.searchsorted(which * step + n, which * step + np.minimum(-(-percent * n // 100), step - 1))
    many = np.maximum(np.arange(len(ids)) - low, 0)
    total, done = np.cumsum(many), 0
    while done < len(ids):
        base = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + MOST_MET, "right")))
        k = many[done:upto]
        x = np.repeat(np.arange(done, upto), k)
        y = np.repeat(low[done:upto] - np.cumsum(k) + k, k) + np.arange(k.sum())
        least = needed(n[x], n[y], percent)
        more = np.minimum(slack, least // SLACK_SHARE)
        near = (at[x] <= n[x] - least + more) & (at[y] <= n[y] - least + more)
        a, b = rows[x[near]], rows[y[near]]
        yield np.minimum(a, b), np.maximum(a, b), more[near]
        done = upto


def added_up(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Columns (src, dst, shared, more), one row a pair."""
    src, dst, shared, more = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(src):
        return [src, dst, shared, more]
    ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
    pair = both[: len(src)] * len(ids) + both[len(src) :]
    order = np.argsort(pair, kind="stable")
    first = np.flatnonzero(np.diff(pair[order], prepend=-1))
    one = order[first]
    return [src[one], dst[one], np.add.reduceat(shared[order], first), more[one]]


def candidates(sets: DataFrame, percent: int, slack: int = SLACK) -> DataFrame:
    """Rows (src, dst) of the pairs that share more of their first terms than their slack, at most ``slack``."""
    names = ["src", "dst", "shared", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, part = [], [], None

        def out() -> Iterator[pa.RecordBatch]:
            columns = added_up(held)
            held[:] = [tuple(columns)]
            if len(columns[0]) > MOST_MET // 2:
                yield from as_batches()

        def as_batches() -> Iterator[pa.RecordBatch]:
            src, dst, shared, more = held.pop()
            part = (mix64(src.view(np.uint64) ^ mix64(dst.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")  # inside a part pairs stay in order of src
            src, dst, shared, more = (x[order] for x in (src, dst, shared, more))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                c = slice(cuts[p], cuts[p + 1])
                columns = np.diff(src[c], prepend=0), dst[c] - src[c], shared[c], more[c]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([packed(x)], pa.binary()) for x in columns)], ["part", *names])

        def lists(whole: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for src, dst, more in met_on_lists(*whole, percent, slack):
                held.append((src, dst, np.ones(len(src), np.int64), more))
                if sum(len(x[0]) for x in held) > MOST_MET:
                    yield from out()

        def one_part() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            waiting.clear()
            order = np.lexsort((columns[2], columns[0]))
            yield from lists([x[order] for x in columns])

        for batch in batches:
            for i, entries in enumerate(read_part(batch)):
                if waiting and batch.column(0)[i].as_py() != part:
                    yield from one_part()
                part = batch.column(0)[i].as_py()
                waiting.append(entries)
        if waiting:
            yield from one_part()
        if held:
            yield from out()
        if held:
            yield from as_batches()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, part = [], None

        def one_part() -> pa.RecordBatch:
            src, dst, shared, more = added_up(waiting)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[shared > more]) for x in (src, dst)], names[:2])

        for batch in batches:
            for p, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and p != part:
                    yield one_part()
                part = p
                src, dst, shared, more = map(unpacked, columns)
                src = np.cumsum(src)
                waiting.append((src, src + dst, shared, more))
        if waiting:
            yield one_part()

    spark = sets.sparkSession
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART_ENTRIES))
    entries = list_parts(sets, percent, slack, parts).repartition(parts, "part").sortWithinPartitions("part")
    met = entries.mapInArrow(run, "part int, src binary, dst binary, shared binary, more binary")
    return met.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add, "src long, dst long")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass, counted in whole: a block of pairs gets each of its sets once."""
    dealt = dealt_by_leader(pairs)
    members = dealt.select("leader", "part", F.explode(F.array("src", "dst")).alias(ROW)).distinct()
    total = members.join(sets.select(ROW, "n"), ROW).agg(F.sum("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("leader", "part"), F.lit(max(1, -(-total // BLOCK_IDS)))).alias("block")
    asked = members.select(block, ROW).distinct().join(sets, ROW)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right[ROW].to_numpy()
        n = right["n"].to_numpy().astype(np.int64)
        _, terms = np.unique(from_binary(right["ids"], n), return_inverse=True)
        order = np.argsort(rows)
        src, dst = (order[np.searchsorted(rows, left[c].to_numpy(), sorter=order)] for c in ("src", "dst"))
        shared = shared_terms(terms, np.cumsum(n) - n, n, src, dst)
        linked = (shared > 0) & (100 * shared >= percent * (n[src] + n[dst] - shared))
        columns = [rows[src], rows[dst], shared, n[src], n[dst]]
        return pa.table([pa.array(x[linked]) for x in columns], [f.split()[0] for f in EDGE_SCHEMA.split(", ")])

    pairs_of, sets_of = dealt.select(block, "src", "dst").groupBy("block"), asked.select("block", ROW, "ids", "n").groupBy("block")
    return pairs_of.cogroup(sets_of).applyInArrow(run, EDGE_SCHEMA)


def dealt_by_leader(pairs: DataFrame) -> DataFrame:
    """Rows (leader, part, src, dst): pairs whose first rows have the same smallest neighbour, in parts of bounded size.

    Records that are all alike meet in one place, so that each of their sets is sent there once.
    """
    pairs = save(pairs, "edge-candidates")
    release(pairs.sparkSession)
    ends = pairs.select(F.col("src").alias(ROW), F.col("dst").alias("other")).unionByName(pairs.select(F.col("dst").alias(ROW), F.col("src").alias("other")))
    leaders = ends.groupBy(F.col(ROW).alias("src")).agg(F.min("other").alias("leader")).select("src", F.least("src", "leader").alias("leader"))
    led = pairs.join(leaders, "src")
    many = led.groupBy("leader").agg(F.count("*").alias("many"))
    part = F.pmod(F.xxhash64("src"), F.lit(1) + F.expr(f"many div {LEADER_PAIRS}"))
    dealt = save(led.join(many, "leader").select("leader", part.alias("part"), "src", "dst"), "edge-groups")
    forget(pairs)
    return dealt


def shared_terms(terms: np.ndarray, starts: np.ndarray, n: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """How many terms each pair of sets (starts, n) has in common."""
    shared = np.zeros(len(src), np.int64)
    mark = np.zeros(int(terms.max(initial=-1)) + 1, bool)
    order = np.argsort(src, kind="stable")
    cuts = np.flatnonzero(np.diff(src[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        pairs = order[a:b]
        mine = terms[starts[src[pairs[0]]] :][: n[src[pairs[0]]]]
        mark[mine] = True
        k = n[dst[pairs]]
        ends = np.cumsum(k)
        found = mark[terms[np.repeat(starts[dst[pairs]] - ends + k, k) + np.arange(ends[-1])]]
        shared[pairs] = np.add.reduceat(found, ends - k, dtype=np.int64)  # sets of candidates aren't empty
        mark[mine] = False
    return shared


def edges_of_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Edges of rows (row_index, ids, n)."""
    ship(sets.sparkSession)
    return compared(candidates(sets, percent), sets, percent)


def edges_by_overlap(records: DataFrame, percent: int, keys: tuple[str, ...] = (), most_df: int = MOST_DF, turns: int = 1) -> DataFrame:
    """Rows (src, dst, shared, n_src, n_dst)."""
    return edges_of_sets(saved_sets(records, keys, most_df, turns), percent)


def linking_edges(
    records: DataFrame, percent: int, keys: tuple[str, ...] = (), most_df: int = MOST_DF, strategy: str = "overlap", turns: int = 1
) -> DataFrame:
    """Rows (src, dst) with the components of the full edge list, which needn't all be in it; ``turns`` as for ``saved_term_sets``."""
    if strategy in ("overlap", "blocks", "prefix"):  # the last two are in saved settings
        return edges_by_overlap(records, percent, keys, most_df, turns).select("src", "dst")
    if strategy == "counts":
        return edges_by_counts(records, percent, keys, most_df).select("src", "dst")
    if strategy != "collapse":
        raise ValueError(f"no such strategy: {strategy}")
    rows = saved_sets(records, keys, most_df, turns)
    digests = rows.select(ROW, F.sha2("ids", 256).alias("digest"))
    same = digests.groupBy("digest").agg(F.min(ROW).alias("first"), F.count("*").alias("many")).where("many > 1")
    copies = save(digests.join(same, "digest").where(F.col(ROW) != F.col("first")).select("first", ROW), "term-set-copies")
    reps = save(rows.join(copies.select(ROW), ROW, "left_anti"), "term-set-classes")
    forget(rows)
    release(records.sparkSession)
    joined = save(edges_of_sets(reps, percent).select("src", "dst"), "linking-edges")
    forget(reps)
    release(records.sparkSession)
    if percent > 100:
        return joined
    return joined.unionByName(copies.select(F.col("first").alias("src"), F.col(ROW).alias("dst")))
