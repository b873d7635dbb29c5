"""CSV records of large files, in as many tasks as the files have blocks.

Spark's text reader cuts files after line breaks, but a break may stand inside a quoted
cell.  After a break a block is in one of two states: between records or inside quotes.
So a first pass parses every block under both and notes, for either, the state at its
end, how many records begin in it, and the lines that belong to a record of the blocks
before or after.  A block is then one of four maps of the two states; a running window over
a file's blocks composes them, which gives each its true state and the number of its
first record, in order of file path and block.  The second pass parses each block
once.  Records that lie in several blocks are sent as pieces and parsed where they meet.

Cells are quoted by double quotes at their start; a doubled one stands for one; what
follows a closing quote belongs to the cell.  Records end at LF, CR LF or CR; empty lines
are none.  Every file begins with a header.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.session import save, ship

AFTER = "\x00after"  # no record of its own is this
BATCH_BYTES = 1 << 22
LONGEST_CELL = (1 << 31) - 1
PLACES = "file string, block long"
SEEN = ", ".join(f"after_{q} boolean, begun_{q} long, head_{q} long, open_{q} long" for q in "sq")
Batches = Iterator[pa.RecordBatch]


def lines_of(text: str) -> Iterator[str]:
    """The lines of a text with their ends; CR alone ends one, too."""
    return io.StringIO(text, newline="") if "\r" in text else iter((text,))


@dataclass
class Walk:
    """What a block is under one state at its start."""

    after: bool = False  # inside quotes at the end
    begun: int = 0  # records that begin here
    head: int = 0  # lines of the record that began before
    open: int = 0  # the first line of the record that ends later, or how many lines there are


def walk(lines: list[str], quoted: bool, sep: str) -> Walk:
    """Parse a block whose first line is inside quotes, or isn't."""
    out, passed, last = Walk(open=len(lines)), 0, 0
    if not any('"' in x for x in lines):
        return Walk(True, 0, len(lines), len(lines)) if quoted else Walk(False, sum(bool(x.strip("\r\n")) for x in lines), 0, len(lines))

    def fed() -> Iterator[str]:
        nonlocal passed
        for i, x in enumerate(lines):
            passed = i + 1
            yield '"' + x if quoted and not i else x
        passed += 1
        yield AFTER

    first = quoted
    for record in csv.reader(fed(), delimiter=sep):
        if passed > len(lines):
            out.after = record != [AFTER]
            if out.after and first:
                out.head = len(lines)
            elif out.after:
                out.begun, out.open = out.begun + 1, last
            return out
        if first:
            out.head, first = passed, False
        elif record:
            out.begun += 1
        last = passed
    return out


def blocks(batches: Batches) -> Iterator[tuple[str, int, list[str], bool]]:
    """(file, block, lines, whether all of it is UTF-8) from rows (file, block, value) in reading order."""
    at, held, fine = None, [], True
    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != at:
                if at is not None:
                    yield *at, held, fine
                at, held, fine = (file, block), [], True
            try:
                text = value.decode("utf-8")
            except UnicodeDecodeError:
                text, fine = "", False
            held += lines_of(text + "\n")
    if at is not None:
        yield *at, held, fine


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, block, value): the lines of every block of the files, in reading order."""
    read = ship(spark).read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def surveyed(rows: DataFrame, sep: str) -> DataFrame:
    """One row a block: whether it is UTF-8, and what it is under either state."""

    def run(batches: Batches) -> Batches:
        csv.field_size_limit(LONGEST_CELL)
        for file, block, lines, fine in blocks(batches):
            if block == 0 and lines:
                lines[0] = lines[0].removeprefix("﻿")
            plain, quoted = (walk(lines, q, sep) for q in (False, True))
            values = [file, block, fine, *(getattr(w, k) for w in (plain, quoted) for k in ("after", "begun", "head", "open"))]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["file", "block", "fine", *(x.split()[0] for x in SEEN.split(", "))])

    return rows.mapInArrow(run, f"{PLACES}, fine boolean, {SEEN}")


def composed(seen: DataFrame) -> DataFrame:
    """Each block's true state, and the numbers of its first record and of its file's header, headers counted."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a block that ends alike under both states hides all before it; one that turns them about counts by parity
    turns = F.sum((F.col("after_s") & ~F.col("after_q")).cast("long"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    marked = seen.withColumn("_turns", turns.over(upto)).withColumn("_same", F.when(F.col("after_s") == F.col("after_q"), F.struct(F.col("after_s").alias("state"), "_turns")))
    last = F.last("_same", ignorenulls=True).over(before)
    turned = F.coalesce(F.max("_turns").over(before), F.lit(0)) - F.coalesce(last["_turns"], F.lit(0))
    quoted = F.coalesce(last["state"], F.lit(False)) != (turned % 2 == 1)
    found = marked.select("file", "block", quoted.alias("quoted"), *[c for c in seen.columns if c[-2:] in ("_s", "_q")])
    own = {k: F.when(F.col("quoted"), F.col(f"{k}_q")).otherwise(F.col(f"{k}_s")) for k in ("after", "begun", "head", "open")}
    found = found.select("file", "block", *[v.alias(k) for k, v in own.items()])
    files = found.groupBy("file").agg(F.sum("begun").alias("records")).where("records > 0")  # a row a file
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("header"), F.row_number().over(Window.orderBy("file")).alias("headers"))
    first = F.col("header") + F.coalesce(F.sum("begun").over(before), F.lit(0))
    return found.join(starts, "file").withColumn("first", first)


def read_records(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, list[str], bool]:
    """Records (row_index, cells) in order of file and place, the first file's header, and whether all is UTF-8."""
    rows = text_blocks(spark, path)
    seen = save(surveyed(rows, sep), "csv-blocks")
    fine = seen.where("not fine").isEmpty()
    # a row a block of what one task reads
    table = {(r.file, r.block): r for r in composed(seen).collect()} if fine else {}
    if not table:
        return spark.createDataFrame([], "row_index long, cells array<string>"), [], fine
    shared = spark.sparkContext.broadcast({k: tuple(r[2:]) for k, r in table.items()})

    def whole(batches: Batches) -> Batches:
        csv.field_size_limit(LONGEST_CELL)
        for file, block, lines, _ in blocks(batches):
            if (file, block) in shared.value:
                _, _, head, upto, header, headers, first = shared.value[file, block]
                if block == 0:
                    lines[0] = lines[0].removeprefix("﻿")
                yield from as_batches(numbered(csv.reader(lines[head:upto], delimiter=sep), first, header, headers))

    def pieces(batches: Batches) -> Batches:
        for file, block, lines, _ in blocks(batches):
            if (file, block) in shared.value:
                after, begun, head, upto, header, headers, first = shared.value[file, block]
                found = [(first - 1, lines[:head])] if head else []
                found += [(first + begun - 1, lines[upto:])] if after and upto < len(lines) else []
                for n, part in found:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (n, block, header, headers, "".join(part))], ["n", "block", "header", "headers", "text"])

    def joined(batches: Batches) -> Batches:
        csv.field_size_limit(LONGEST_CELL)
        for batch in batches:
            for n, header, headers, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from as_batches(numbered(csv.reader(io.StringIO(text, newline=""), delimiter=sep), n, header, headers))

    out = "row_index long, cells array<string>"
    found = rows.mapInArrow(whole, out)
    if any(r.head or r.after for r in table.values()):
        cut = save(rows.mapInArrow(pieces, "n long, block long, header long, headers long, text string"), "csv-pieces")
        texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")  # one record's
        found = found.unionByName(cut.groupBy("n", "header", "headers").agg(texts.alias("text")).select("n", "header", "headers", "text").mapInArrow(joined, out))
    return found, header_of(spark, min(f for f, _ in table), sep), fine


def numbered(records: Iterable[list[str]], first: int, header: int, headers: int) -> Iterator[tuple[int, list[str]]]:
    for n, cells in enumerate((x for x in records if x), first):
        if n != header:
            yield n - headers, cells


def as_batches(records: Iterable[tuple[int, list[str]]]) -> Batches:
    at, cells, held = [], [], 0
    for n, row in records:
        at.append(n)
        cells.append(row)
        held += sum(map(len, row)) + 8 * len(row)
        if held >= BATCH_BYTES:
            yield as_batch(at, cells)
            at, cells, held = [], [], 0
    if at:
        yield as_batch(at, cells)


def as_batch(at: list[int], cells: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["row_index", "cells"])


def header_of(spark: SparkSession, file: str, sep: str) -> list[str]:
    """The first record of a file, from as many of its lines as it takes."""
    read, n = spark.read.option("lineSep", "\n").text(unquote(file)), 1
    while True:
        lines = [r[0] + "\n" for r in read.limit(n).collect()]
        lines[0] = lines[0].removeprefix("﻿")
        split = [x for line in lines for x in lines_of(line)]
        state = walk(split, False, sep)
        if len(lines) < n or state.begun > state.after:
            return next((x for x in csv.reader(split, delimiter=sep) if x), [])
        n *= 4
