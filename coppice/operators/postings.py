"""Posting lists of valid terms, with the long table of terms never written out.

As in ``termsets``, tasks send, by range of hashes, every term of a block of texts once with
the records of the block that have it, in compressed columns; here a term goes in its own
letters.  A range tells terms apart by these, and gives their lists: what is moved, once, is
about the text twice.  Hashes decide inside a block only (two of its million terms are taken
for one with a chance of about 3 in 10**8).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.hashed import found_terms, spelled, spots_of
from coppice.functions.packing import packed, spans, stepped, summed, unpacked
from coppice.functions.text import normalize_text
from coppice.operators.features import LEAST_DF, MOST_DF
from coppice.operators.records import ROW
from coppice.operators.termsets import BLOCK_TERMS, SLICE_CHARS, hash_ranges, range_of, table_of, text_bytes
from coppice.session import ship

SENT = "part int, terms binary, counts binary, places binary, rows binary"


def terms_by_block(records: DataFrame, most: int, ranges: int) -> DataFrame:
    """Rows (part, ...): the distinct terms of a block whose hashes fall into a range, and the places of their records among ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, base, before = [], 0, 0, 0
        for batch in batches:
            row, texts = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_pylist()
            cuts = np.cumsum([len(t) for t in texts]) // SLICE_CHARS
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cuts)) + 1):
                hashes, of, (chars, *where) = found_terms([texts[i] for i in part])
                held.append((row[part], chars, hashes, (of + before).astype(np.uint32), spots_of(*where, base)))
                many, base, before = many + len(hashes), base + len(chars), before + len(part)
                if many >= BLOCK_TERMS:
                    yield from block_of(held)
                    held, many, base, before = [], 0, 0, 0
        if many:
            yield from block_of(held)

    def block_of(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        rows, chars, hashes, of, spots = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
        held.clear()
        by_row = np.argsort(rows)
        rows, rank = rows[by_row], np.empty(len(rows), np.int64)
        rank[by_row] = np.arange(len(rows))
        order = np.argsort(hashes, kind="stable")
        hashes, of = hashes[order], of[order]
        fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))
        hashes, of, order = hashes[fresh], rank[of[fresh]], order[fresh]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        n, hashes, order = np.diff(np.append(starts, len(of))), hashes[starts], order[starts]
        listed = np.where(n > most, 0, n)  # too frequent in this block alone
        places, ends = of[spans(starts, listed)], np.cumsum(listed)
        whole = packed(np.diff(rows, prepend=0))
        cuts = np.searchsorted(range_of(hashes, ranges), np.arange(ranges + 1))
        for part in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[part], cuts[part + 1]
            mine, named, k = places[ends[a] - listed[a] : ends[b - 1]], whole, listed[a:b]
            if len(whole) > len(mine):  # fewer rows than the block has
                used, mine = np.unique(mine, return_inverse=True)
                named = packed(np.diff(rows[used], prepend=0))
            mine = mine[np.lexsort((mine, np.repeat(np.arange(b - a), k)))]
            terms = zstandard.compress(spelled(chars, spots[:, order[a:b]]))
            values = [part], [terms], [packed(np.minimum(n[a:b], most + 1))], [packed(stepped(mine, k))], [named]
            yield from table_of(SENT, list(values)).to_batches()

    text = F.coalesce(normalize_text(F.col("analysis_text")), F.lit("")).alias("text")
    return records.select(F.col(ROW).cast("long"), text).mapInArrow(run, SENT)


def inverted_index(records: DataFrame, least: int = LEAST_DF, most: int = MOST_DF) -> DataFrame:
    """Rows (term, df, rows): posting lists of valid terms, rows ascending, at most ``most`` each."""
    ship(records.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        data = np.frombuffer(b"".join(zstandard.decompress(x) for x in table["terms"].to_pylist()), np.uint8)
        ends = np.flatnonzero(data == ord("\n"))
        offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int32)
        letters = pa.py_buffer(data[data != ord("\n")])
        coded = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), letters).dictionary_encode()
        which = coded.indices.to_numpy()
        counts = [unpacked(x) for x in table["counts"].to_pylist()]
        df = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        valid, found, rows, at = (df >= least) & (df <= most), [], [], 0
        for n, steps, named in zip(counts, table["places"].to_pylist(), table["rows"].to_pylist(), strict=True):
            mine, at, listed = which[at : at + len(n)], at + len(n), np.where(n > most, 0, n)
            kept = np.repeat(valid[mine], listed)
            found.append(np.repeat(mine, listed)[kept])
            rows.append(np.cumsum(unpacked(named))[summed(unpacked(steps), listed)[kept]])
        found, rows = np.concatenate(found), np.concatenate(rows)
        order = np.lexsort((rows, found))
        terms, n = np.unique(found, return_counts=True)
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), pa.array(rows[order]))
        return pa.table([coded.dictionary.take(pa.array(terms)), pa.array(df[terms]), lists], ["term", "df", "rows"])

    ranges = hash_ranges(records, text_bytes(records))
    return terms_by_block(records, most, ranges).groupBy("part").applyInArrow(run, "term string, df long, rows array<long>")
