"""Exact Jaccard join of shingle sets by set-relation skipping, and its components.

Documents with equal sets are one set from the start.  Sets meet through an
inverted index over prefixes: tokens are ordered by how many sets share their
bucket (a fixed-size count array that every task adds to), rare first, and a set
enters the lists of its first ``n - ceil(t n) + 1`` tokens with its size and the
token's position.

Index-level skipping.  At its first common token a pair at sizes n, m and
positions i, j can share at most min(n - i, m - j) tokens, so a list is blocked
by position: the smaller set of a pair is only found where its position lies in
the first block (i <= n - ceil(2t/(1+t) n)); later blocks are skipped for it, and
pairs of entries whose sizes or positions rule them out are skipped.  Lists that
one passage makes long hold that token in late blocks.

Answer-level skipping.  Lists of a few entries give all their pairs.  A longer
list has a leader, the entry of lowest position (the set with least of its own),
and every entry is compared with the leader it shares most lists with: one pair
an entry.  The answers of the other entries are derived from the leader's:
entries in the leader's component need no pair among themselves, and what remains
(entries whose components differ) is bounded by the overlaps already known,
|x & y| <= |x & l| + |y| - |y & l|, before anything is compared.  Remaining pairs
are then compared like any others.

Candidates pass a parity filter (256-bit parities of both sets differ in at most
|x - y| + |y - x| bits) and are verified on the texts of one document a set.
Every pair that links is found or joins sets that other links join already, so
components are exact; copies are never expanded into pairs.

Links.  All links lie inside components.  The sets of a component are dealt into
blocks, and every two blocks are compared in whole, by products of their tables of
tokens; what leaves a task is a number of links a set, weighted by copies.

Null and empty texts have no shingles, link with nothing and are their own
component; rows that repeat a doc_id share one component; rows without an id join
the component of documents with an equal set and link with nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, give_back, mix64, slices, table
from coppice.llm.shingles import shingle_sets
from coppice.operators.components import connected_components
from coppice.session import forget, save, ship, spread

BUCKETS = 1 << 18
SHORT_LIST = 4
PARITY_WORDS = 4
FETCH_BITS = 26
BLOCK_SETS = 512
TOKEN_COLUMNS = 1 << 13
LEAST_SIEVE_BITS, MOST_SIEVE_BITS = 20, 28
SET, BUCKET = 0, 1


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    a = mix64(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    b = mix64(shingles ^ np.uint64(0x7F4A7C159E3779B9)).sum(dtype=np.uint64)
    n = np.uint64(len(shingles))
    return tuple(mix64(np.array([a + n, b ^ n], np.uint64)).view(np.int64).tolist())


def parity(shingles: np.ndarray) -> list[int]:
    """For each of 256 classes of tokens, whether the set has an odd number of them."""
    odd = np.bincount((shingles >> np.uint64(48)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def describe(df: DataFrame, text: str, id_col: str, width: int) -> DataFrame:
    """Rows of two kinds: sets (id, n, a, b, parity words) and bucket counts (id null, a bucket, n count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, id_type = np.zeros(BUCKETS, np.int64), set(), None
        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch):
                rows = []
                for s in shingle_sets(part.column(1).to_pylist(), width):
                    a, b = signature(s)
                    rows.append((len(s), a, b, *parity(s)))
                    if (a, b) not in seen:
                        seen.add((a, b))
                        np.add.at(counts, (s % np.uint64(BUCKETS)).astype(np.int64), 1)
                columns = np.array(rows, np.int64).reshape(-1, 3 + PARITY_WORDS).T
                kind = pa.array(np.full(part.num_rows, SET, np.int32))
                yield pa.RecordBatch.from_arrays([kind, part.column(0), *map(pa.array, columns.copy())], names)
        give_back()
        used = np.flatnonzero(counts)
        if len(used):
            nothing = [pa.nulls(len(used), pa.int64())] * (1 + PARITY_WORDS)
            kind = pa.array(np.full(len(used), BUCKET, np.int32))
            no_id = pa.nulls(len(used), id_type)
            yield pa.RecordBatch.from_arrays([kind, no_id, pa.array(counts[used]), pa.array(used), *nothing], names)

    names = ["kind", "id", "n", "a", "b", *(f"p{k}" for k in range(PARITY_WORDS))]
    id_kind = df.schema[id_col].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in names[2:])
    return df.select(id_col, text).mapInArrow(run, f"kind int, id {id_kind}, {columns}")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def postings(
    df: DataFrame, text: str, width: int, percent: int, order: np.ndarray, wanted: np.ndarray | None = None
) -> DataFrame:
    """Rows (token, a, n, at) of every set's prefix under the global order; with ``wanted``, of its tokens only."""
    shared = df.sparkSession.sparkContext.broadcast((order, wanted))  # both bounded at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (order, wanted) = set(), shared.value
        for batch in batches:
            for part in slices(batch):
                out = [], [], [], []
                for s in shingle_sets(part.column(0).to_pylist(), width):
                    mark = signature(s)
                    if not len(s) or mark in seen:
                        continue
                    seen.add(mark)
                    often = order[(s % np.uint64(BUCKETS)).astype(np.int64)]
                    first = s[np.lexsort((s, often))[: prefix_length(len(s), percent)]]
                    at = np.arange(len(first), dtype=np.int32) if wanted is None else in_sieve(wanted, first)
                    k = len(at)
                    columns = first[at].view(np.int64), np.full(k, mark[0]), np.full(k, len(s), np.int32), at
                    for values, x in zip(out, columns, strict=True):
                        values.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "a", "n", "at"])
        give_back()

    return df.select(text).mapInArrow(run, "token long, a long, n int, at int")


def required(n: Column, m: Column, percent: int) -> Column:
    """The least overlap at which sets of n and m tokens link."""
    return F.ceil((n + m) * percent / F.lit(100.0 + percent) - 1e-9)


def admissible(x: str, y: str, percent: int) -> Column:
    """Size and position filters of two entries of a list."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    share = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (share >= required(n, m, percent))


def first_block(percent: int) -> Column:
    """Where the smaller set of a pair may be found."""
    return F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / F.lit(100.0 + percent) - 1e-9)


def ordered_pairs(df: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b from columns x and y."""
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    some = lists.where(F.col("df") <= SHORT_LIST)
    small, large = some.where(first_block(percent)).alias("s"), some.alias("g")
    later = (F.col("g.n") > F.col("s.n")) | ((F.col("g.n") == F.col("s.n")) & (F.col("g.a") != F.col("s.a")))
    met = small.join(large, (F.col("s.token") == F.col("g.token")) & later & admissible("s", "g", percent))
    return met.select(F.col("s.a").alias("x"), F.col("g.a").alias("y"))


def leaders_of(lists: DataFrame) -> DataFrame:
    least = F.min(F.struct("at", "n", "a")).alias("l")
    return lists.where(F.col("df") > SHORT_LIST).groupBy("token").agg(least).select("token", "l.*")


def leader_pairs(long: DataFrame, percent: int) -> DataFrame:
    """Each entry with the leader it shares most lists with; its other leaders are left to ``rest_pairs``."""
    entry = F.struct("a", "n", "at").alias("x")
    leader = F.struct(F.col("la").alias("a"), F.col("ln").alias("n"), F.col("lat").alias("at")).alias("y")
    met = long.select(entry, leader).where("x.a <> y.a").where(admissible("x", "y", percent))
    counted = met.groupBy(F.col("x.a").alias("x"), F.col("y.a").alias("y")).agg(F.count("*").alias("lists"))
    return counted.groupBy("x").agg(F.max_by("y", F.struct("lists", "y")).alias("y"))


def rest_pairs(long: DataFrame, components: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """Pairs of long lists whose components differ and that the leader's answers don't rule out."""
    known = components.select(F.col("node").alias("a"), "component")
    own = F.coalesce("component", "a")
    both = compared.select(F.col("a").alias("x"), F.col("b").alias("y"), "overlap").unionByName(
        compared.select(F.col("b").alias("x"), F.col("a").alias("y"), "overlap")
    )
    entries = (
        long.join(known, "a", "left")
        .withColumn("component", own)
        .join(known.select(F.col("a").alias("la"), F.col("component").alias("lc")), "la", "left")
        .withColumn("lc", F.coalesce("lc", "la"))
        .join(both.select(F.col("x").alias("a"), F.col("y").alias("la"), "overlap"), ["a", "la"], "left")
        .withColumn("overlap", F.when(F.col("a") == F.col("la"), F.col("n")).otherwise(F.col("overlap")))
        .select("token", "a", "n", "at", "component", "lc", "overlap")
    )
    entries = save(entries, "join-entries")
    strayed = F.col("component") != F.col("lc")
    mixed = entries.where(strayed).select("token").distinct()
    entries = entries.join(mixed, "token", "left_semi")
    small = entries.where(first_block(percent))
    bound = F.least(
        F.col("s.overlap") + F.col("g.n") - F.col("g.overlap"), F.col("g.overlap") + F.col("s.n") - F.col("s.overlap")
    )
    possible = F.coalesce(bound >= required(F.col("s.n"), F.col("g.n"), percent), F.lit(True))

    def meet(small: DataFrame, large: DataFrame) -> DataFrame:
        s, g = small.alias("s"), large.alias("g")
        later = (F.col("g.n") > F.col("s.n")) | ((F.col("g.n") == F.col("s.n")) & (F.col("g.a") != F.col("s.a")))
        apart = F.col("s.component") != F.col("g.component")
        on = (F.col("s.token") == F.col("g.token")) & later & apart & admissible("s", "g", percent) & possible
        return s.join(g, on).select(F.col("s.a").alias("x"), F.col("g.a").alias("y"))

    return meet(small.where(strayed), entries).unionByName(meet(small.where(~strayed), entries.where(strayed)))


def sieve(df: DataFrame, bits: int, *places: Column) -> np.ndarray:
    """A table of 2 ** bits bits with the bits at ``places`` of every row set; only ever a prefilter."""
    words = (
        df.select(F.explode(F.array(*places)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def bits_set(table_: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (table_[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def token_sieve(tokens: DataFrame) -> np.ndarray:
    """Of tokens, which are hashes already: their lowest and highest bits are the places."""
    n = tokens.count()
    bits = min(max((8 * n).bit_length(), LEAST_SIEVE_BITS), MOST_SIEVE_BITS)
    low = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    return sieve(tokens, bits, low, F.shiftrightunsigned("token", 64 - bits))


def in_sieve(table_: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Positions of the tokens that may be in the sieve."""
    bits = len(table_).bit_length() + 5
    low, high = tokens & np.uint64((1 << bits) - 1), tokens >> np.uint64(64 - bits)
    return np.flatnonzero(bits_set(table_, low) & bits_set(table_, high)).astype(np.int32)


def fetch(df: DataFrame, ids: DataFrame, text: str, id_col: str) -> DataFrame:
    """Rows (a, text): the text of one document of each set in ``ids`` (a, id)."""

    def places(c: str) -> list[Column]:
        return [F.shiftrightunsigned(F.xxhash64(F.lit(k), F.col(c)), 64 - FETCH_BITS) for k in range(2)]

    shared = df.sparkSession.sparkContext.broadcast(sieve(ids, FETCH_BITS, *places("id")))  # a fixed size

    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (batch.column(c).to_numpy().astype(np.uint64) for c in (2, 3))
        keep = bits_set(shared.value, one) & bits_set(shared.value, two)
        return batch.select([0, 1]).filter(pa.array(keep))

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"), *places(id_col))
    few = arrow_map(rows.toDF("id", "t", "b0", "b1"), wanted, f"id {kind}, t string")
    return few.groupBy("id").agg(F.max("t").alias("t")).join(ids, "id").select("a", "id", "t")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities don't rule them out."""
    words = [f"p{k}" for k in range(PARITY_WORDS)]
    x = sets.select(F.col("a"), F.col("n").alias("nx"), *[F.col(w).alias("x" + w) for w in words])
    y = sets.select(F.col("a").alias("b"), F.col("n").alias("ny"), *[F.col(w).alias("y" + w) for w in words])
    apart = sum((F.bit_count(F.col("x" + w).bitwiseXOR(F.col("y" + w))) for w in words), F.lit(0))
    need = required(F.col("nx"), F.col("ny"), percent)
    few = pairs.join(x, "a").join(y, "b").where(apart <= F.col("nx") + F.col("ny") - 2 * need)
    return few.select("a", "b").distinct()


def verify(df: DataFrame, few: DataFrame, sets: DataFrame, text: str, id_col: str, width: int, percent: int) -> DataFrame:
    """Rows (a, b, overlap, linked) for pairs (a, b), from the texts of their sets."""
    involved = few.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    ids = save(sets.where("id is not null").join(involved, "a", "left_semi").select("a", "id"), "join-wanted")
    texts = save(fetch(df, ids, text, id_col), "join-texts")
    left, right = texts.select("a", F.col("t").alias("tx")), texts.select(F.col("a").alias("b"), F.col("t").alias("ty"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, which = np.unique(batch.column(0).to_numpy(), return_index=True)
        firsts = dict(zip(one.tolist(), shingle_sets(batch.column(2).take(pa.array(which)).to_pylist(), width), strict=True))
        others = shingle_sets(batch.column(3).to_pylist(), width)
        common, linked = [], []
        for a, s in zip(batch.column(0).to_pylist(), others, strict=True):
            r = firsts[a]
            at = np.minimum(np.searchsorted(r, s), len(r) - 1)
            both = int((r[at] == s).sum())
            common.append(both)
            linked.append(100 * both >= percent * (len(r) + len(s) - both))
        arrays = [batch.column(0), batch.column(1), pa.array(common, pa.int32()), pa.array(linked, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "overlap", "linked"])

    met = few.join(right, "b").join(left, "a").select("a", "b", "tx", "ty")
    return arrow_map(met, compare, "a long, b long, overlap int, linked boolean")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens every set of ``left`` shares with every set of ``right``."""
    sets = [*left, *right]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, TOKEN_COLUMNS):
        a, b = np.searchsorted(column, (low, low + TOKEN_COLUMNS))
        has = np.zeros((len(sets), min(TOKEN_COLUMNS, int(column[b - 1]) - low + 1)), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def link_counts(
    df: DataFrame, sets: DataFrame, components: DataFrame, text: str, id_col: str, width: int, percent: int
) -> DataFrame:
    """Rows (a, b, links): of each set with links, the number of rows with another set that it links with."""
    members = sets.where("id is not null").join(components.select(F.col("node").alias("a"), "component"), "a")
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("blocks"))
    placed = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("a", "b"), "blocks"))
    placed = save(placed.select("component", "blocks", "block", "a", "b", "id", "copies"), "join-members")
    texts = fetch(df, placed.select("a", "id").distinct(), text, id_col)
    pairs = (
        placed.join(texts, ["a", "id"])
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "a", "b", "copies", "t")
        .repartition("component", "low", "high")
        .sortWithinPartitions("component", "low", "high")
    )

    def compare(key: tuple, rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        found = shingle_sets([r[3] for r in rows], width)
        blocks, copies = np.array([r[0] for r in rows]), np.array([r[4] for r in rows], np.int64)
        sizes, own = np.array([len(x) for x in found]), key[1] == key[2]
        one, two = np.flatnonzero(blocks == key[1]), np.flatnonzero(blocks == key[2])
        if not len(one) or not len(two):
            return
        both = overlaps([found[i] for i in one], [found[i] for i in two])
        linked = 100 * both >= percent * (sizes[one][:, None] + sizes[two] - both)
        if own:
            np.fill_diagonal(linked, False)
        for at, n in ((one, linked @ copies[two]), (two, copies[one] @ linked)):
            yield from ((rows[i][1], rows[i][2], int(x)) for i, x in zip(at, n, strict=True) if x)
            if own:
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.copy()], ["a", "b", "links"])

        key, rows, done = None, [], []
        for batch in batches:
            for part in slices(batch):
                for component, low, high, block, a, b, copies, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (component, low, high) != key:
                        done += compare(key, rows) if len(rows) > 1 else []
                        key, rows = (component, low, high), []
                    rows.append((block, a, b, t, copies))
                if done:
                    yield out(done)
                    done = []
        done += compare(key, rows) if len(rows) > 1 else []
        if done:
            yield out(done)
        give_back()

    return pairs.mapInArrow(run, "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links"))


def jaccard_components(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 4, percent: int = 85, links: bool = False
) -> DataFrame:
    """Columns id, n_shingles, component_id, copies, with ``links`` also n_links; one row a row of ``df``.

    ``component_id`` is the smallest id reachable over links of Jaccard similarity
    of at least ``percent`` hundredths; ``copies`` counts the rows with an equal set,
    ``n_links`` the other rows that a row links with, copies among them.
    """
    ship(df.sparkSession)
    described = save(describe(df, text, id_col, width), "join-sets")
    order = np.zeros(BUCKETS, np.int64)
    for bucket, n in described.where(F.col("kind") == BUCKET).groupBy("a").agg(F.sum("n")).collect():
        order[bucket] = n
    words = [F.any_value(f"p{k}").alias(f"p{k}") for k in range(PARITY_WORDS)]
    rows = described.where((F.col("kind") == SET) & (F.col("n") > 0))
    # two sets may share the hash a; both stay under it and each of their pairs is verified
    sets = save(rows.groupBy("a", "b", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *words), "join-classes")
    lists = save(index_lists(df, text, width, percent, order), "join-lists")
    leaders = leaders_of(lists).select("token", F.col("a").alias("la"), F.col("n").alias("ln"), F.col("at").alias("lat"))
    long = save(lists.where(F.col("df") > SHORT_LIST).join(leaders, "token"), "join-long")
    pairs = ordered_pairs(short_pairs(lists, percent).unionByName(leader_pairs(long, percent)))
    few = save(possible(pairs, sets, percent), "join-pairs")
    compared = save(verify(df, few, sets, text, id_col, width, percent), "join-compared")
    edges = compared.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    components = save(connected_components(edges), "join-components")
    rest = ordered_pairs(rest_pairs(long, components, compared, percent)).join(compared, ["a", "b"], "left_anti")
    rest = save(possible(rest, sets, percent), "join-rest")
    if not rest.isEmpty():
        more = save(verify(df, rest, sets, text, id_col, width, percent), "join-compared")
        edges = edges.unionByName(more.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        components = save(connected_components(edges), "join-components")
    forget(lists, long, few)
    classes = sets.join(components.select(F.col("node").alias("a"), "component"), "a", "left")
    least = classes.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    classes = classes.join(least, "component", "left").select("a", "b", "n", "copies", F.coalesce("least", "id").alias("component_id"))
    if links:
        counted = save(link_counts(df, sets, components, text, id_col, width, percent), "join-links")
        classes = classes.join(counted, ["a", "b"], "left")
    found = described.where(F.col("kind") == SET).select("id", "n", "a", "b")
    return found.join(classes, ["a", "b", "n"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        *([(F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links")] if links else []),
    )


def index_lists(df: DataFrame, text: str, width: int, percent: int, order: np.ndarray) -> DataFrame:
    """Entries (token, a, n, at, df) of the lists with two entries or more; df counts a set once a task.

    Tokens are counted first, alone; then only entries of repeated tokens are sent.
    """
    counted = postings(df, text, width, percent, order).groupBy("token").agg(F.count("*").cast("int").alias("df"))
    repeated = save(counted.where("df > 1"), "join-tokens")
    wanted = postings(df, text, width, percent, order, token_sieve(repeated))
    return wanted.distinct().join(repeated, "token")


def op1_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spread(table(spark, sf_dir, "documents")), links=True)
