"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (lower-cased, white space as one space) may differ
from a passage by ``k = m * edit_share`` edits.  It is split into k + 1 pieces;
a passage within k edits contains one of them unchanged, so exact piece hits of
one automaton find every candidate, and Myers' bit-parallel distance verifies it
in the surrounding window of the document.  Documents never move: the benchmark
goes to them in blocks of bounded size, one pass over the documents a block.

Null and empty items and texts match nothing; repeated items and documents are
each matched, rows and items without an id too; an item shorter than ``exact_below``
characters has no edit budget and must stand at word boundaries (0: every item has
its budget).  Where the item's column has the name of another, it is called ``item``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from coppice.llm.common import arrow_map, table
from coppice.session import spread

EDIT_SHARE = 0.05
EXACT_BELOW = 20
BLOCK_CHARS = 8_000_000  # of benchmark text in one automaton and one broadcast


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, edit_share: float = EDIT_SHARE, exact_below: int = EXACT_BELOW) -> int:
    return 0 if length < exact_below else int(length * edit_share)


def pieces(pattern: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length, each with its offset."""
    cuts = [len(pattern) * i // (k + 1) for i in range(k + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers_search(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Lowest distance of the pattern to any substring of ``text`` and where it ends; None above ``most``.

    One machine of vertical differences, m bits wide, moves a column a character
    (Myers 1999); Python integers hold any width.
    """
    ones = (1 << m) - 1
    last = 1 << (m - 1)
    plus, minus, score, best = ones, 0, m, (most + 1, -1)
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        carry = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (ones & ~(carry | plus))
        down = plus & carry
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 & ones
        down = down << 1 & ones
        vertical = eq | minus
        plus = down | (ones & ~(vertical | up))
        minus = up & vertical
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= most else None


@dataclass
class Block:
    """Some test items; the automaton is built once in each worker that meets the block."""

    items: list[tuple[object, str]]
    edit_share: float
    exact_below: int = EXACT_BELOW
    _parts: tuple | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_parts": None}

    def budget(self, pattern: str) -> int:
        return budget(len(pattern), self.edit_share, self.exact_below)

    def parts(self) -> tuple:
        if self._parts is None:
            import ahocorasick

            automaton, found = ahocorasick.Automaton(), {}
            for i, (_, pattern) in enumerate(self.items):
                for offset, piece in pieces(pattern, self.budget(pattern)):
                    found.setdefault(piece, []).append((i, offset))
            for piece, places in found.items():
                automaton.add_word(piece, (len(piece), places))
            automaton.make_automaton()
            self._parts = automaton, [myers_masks(p) for _, p in self.items]
        return self._parts

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of every item within its budget of some passage of the text."""
        automaton, masks = self.parts()
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, places) in automaton.iter(text):
            for i, offset in places:
                pattern = self.items[i][1]
                if best.get(i, (1, 0))[0] == 0:
                    continue
                k, start = self.budget(pattern), end + 1 - size - offset
                if (i, start) in tried:
                    continue
                tried.add((i, start))
                if start >= 0 and text.startswith(pattern, start):
                    got = (0, start + len(pattern))
                elif k:
                    low = max(0, start - k)
                    got = myers_search(masks[i], len(pattern), text[low : max(0, start + len(pattern) + k)], k)
                    got = got and (got[0], low + got[1])
                else:
                    got = None
                if got and len(pattern) < self.exact_below and not standing(text, got[1] - len(pattern), got[1]):
                    got = None
                if got and got < best.get(i, (k + 1, 0)):
                    best[i] = got
        return [(i, d, e) for i, (d, e) in sorted(best.items())]


def standing(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, edit_share: float, exact_below: int = EXACT_BELOW) -> list[Block]:
    """The benchmark in blocks of at most ``BLOCK_CHARS`` (one larger item is a block of its own)."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col).orderBy(item_col, text_col)
    blocks, size = [], 0
    for item, text in rows.toLocalIterator():
        pattern = normalise(text)
        if not pattern:
            continue
        if not blocks or size + len(pattern) > BLOCK_CHARS:
            blocks.append(Block([], edit_share, exact_below))
            size = 0
        blocks[-1].items.append((item, pattern))
        size += len(pattern)
    return blocks


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text: str = "text",
    edit_share: float = EDIT_SHARE,
    exact_below: int = EXACT_BELOW,
) -> DataFrame:
    """Rows (id, item, distance, allowed, end): items that a document contains; clean documents have none.

    ``end`` is the place after the passage in the normalised text.
    """
    sc = df.sparkSession.sparkContext
    names = [id_col, "item", "distance", "allowed", "end"]
    kinds, item_kind = dict(df.dtypes), dict(benchmark.dtypes)[item_col]
    schema = f"`{id_col}` {kinds[id_col]}, item {item_kind}, distance int, allowed int, end long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)

    def one(block: Block) -> DataFrame:
        shared = sc.broadcast(block)

        def search(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, found = [], []
            for r, value in enumerate(batch.column(1).to_pylist()):
                if value:
                    for i, d, e in shared.value.matches(normalise(value)):
                        item, pattern = shared.value.items[i]
                        rows.append(r)
                        found.append((item, d, shared.value.budget(pattern), e))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], item_type)]
            arrays += [pa.array(x, k) for x, k in zip(columns[1:], (pa.int32(), pa.int32(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        return arrow_map(df.select(id_col, text), search, schema)

    parts = [one(b) for b in blocks_of(benchmark, item_col, item_text, edit_share, exact_below)]
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("item", "item" if item_col in names else item_col)


def op2_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
