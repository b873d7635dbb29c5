"""Counts under filters from bitmaps: one bit a row, one bitmap a facet value and block of rows.

The bitmaps of a table are built once.  A filter is then OR over the selected values of
a column and AND over columns, block by block; what is visible is counted in bits, and a
group's visible rows are those of its own bitmap AND the filter's.  No filter reads the
table again.  A bitmap covers 32 768 rows in 4 KiB, which compress where few are set.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.operators.explore import FacetFilter
from coppice.operators.records import ROW

BLOCK, POSITION = F.bitmap_bucket_number, F.bitmap_bit_position


def facet_bitmaps(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value, block, bits) of every value of the columns; a missing cell is empty."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in columns])
    long = rows.select(ROW, F.explode(cells).alias("cell")).select(ROW, "cell.*")
    return long.groupBy("column", "value", BLOCK(ROW).alias("block")).agg(F.bitmap_construct_agg(POSITION(ROW)).alias("bits"))


def visible_bits(bitmaps: DataFrame, filters: FacetFilter, columns: Sequence[str]) -> DataFrame:
    """Rows (block, bits) of the rows that a filter shows; without an active column, of all rows."""
    # a column that the table doesn't have is empty everywhere
    nothing = any(not values or (c not in columns and "" not in values) for c, values in filters.selected.items())
    active = {c: sorted(values) for c, values in filters.selected.items() if c in columns}
    if nothing:
        return bitmaps.where(F.lit(False)).select("block", "bits")
    if not active:
        return bitmaps.where(F.col("column") == columns[0]).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    chosen = reduce(Column.__or__, ((F.col("column") == c) & F.col("value").isin(v) for c, v in active.items()))
    shown = bitmaps.where(chosen).groupBy("column", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = shown.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return both.where(F.col("n") == len(active)).select("block", "bits")


def visible_count(bits: DataFrame) -> DataFrame:
    """One row: how many rows are visible."""
    return bits.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("visible"))


def visible_members(members: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows of a table with ``row_index`` that are visible."""
    tested = members.withColumns({"block": BLOCK(ROW), "_place": POSITION(ROW)}).join(bits, "block")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return tested.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0).select(members.columns)


def visible_groups(members: DataFrame, bits: DataFrame, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Groups with visible rows and how many, from the groups' own bitmaps."""
    own = members.groupBy(*keys, BLOCK(ROW).alias("block")).agg(F.bitmap_construct_agg(POSITION(ROW)).alias("bits"))
    met = own.join(bits.select("block", F.col("bits").alias("shown")), "block")
    two = met.select(*keys, "block", F.explode(F.array("bits", "shown")).alias("bits"))
    both = two.groupBy(*keys, "block").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("visible")).where("visible > 0")
