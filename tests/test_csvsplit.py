"""CSV in many tasks against one parser over the whole file."""

import csv
import io
import random

import pytest

from coppice.sources import csvsplit as V
from coppice.sources import tables


def plain(text):
    return [x for x in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if x]


def wild(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choices(['"', '""', ",", "\n", "\r\n", "a", "bc", " ", "é", '\n"', '",', '"\n'], k=n))


def cut_into_blocks(text, rng):
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    out, at = [], 0
    while at < len(lines):
        k = rng.randint(1, 4)
        out.append([y for x in lines[at : at + k] for y in V.lines_of(x + "\n")])
        at += k
    return out


def records_from_blocks(blocks):
    """The method in plain Python: two walks a block, states composed in order, pieces joined."""
    quoted, number, whole, pieces = False, 0, {}, {}
    for lines in blocks:
        w = V.walk(lines, quoted, ",")
        if w.head:
            pieces.setdefault(number - 1, []).extend(lines[: w.head])
        for k, cells in enumerate(x for x in csv.reader(lines[w.head : w.open]) if x):
            whole[number + k] = cells
        number += w.begun
        if w.after and w.open < len(lines):
            pieces.setdefault(number - 1, []).extend(lines[w.open :])
        quoted = w.after
    for n, part in pieces.items():
        assert n not in whole
        whole[n] = next(x for x in csv.reader(part) if x)
    return [whole[n] for n in sorted(whole)]


def test_blocks_of_wild_texts():
    for seed in range(1500):
        text = wild(seed, 60)
        assert records_from_blocks(cut_into_blocks(text, random.Random(seed))) == plain(text + ("" if text.endswith("\n") else "\n")), repr(text)


@pytest.mark.parametrize("size", [400, 1 << 27])
def test_files_in_many_tasks(spark, tmp_path, size):
    """Quoted breaks, doubled quotes, CR, records over several blocks, ragged rows; three files of unequal size."""
    rng, expected = random.Random(size), []
    for k, n in enumerate((7, 160, 40)):
        rows = [[f"f{k}-{i}", rng.choice(["plain", 'two\nlines, "quoted"', "long\n" * rng.choice([1, 90]), "", "cr\r\nhere", "é"]), *["x"] * rng.choice([0, 0, 1, 2])] for i in range(n)]
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows([["Number", "Summary", "Kind"], *rows])
        (tmp_path / f"{'cab'[k]}.csv").write_bytes(("﻿" if k == 1 else "").encode() + out.getvalue().encode())
        expected.append((f"{'cab'[k]}.csv", rows))
    rows = [x for _, part in sorted(expected) for x in part]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        source = tables.import_csv(spark, str(tmp_path))
        got = {r.row_index: list(r)[1:] for r in source.df.collect()}
        extras = {r.row_index: r.cells for r in source.extras.collect()}
        tasks = V.text_blocks(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert source.headers == ["Number", "Summary", "Kind"]
    assert got == {i: (x + [""])[:3] for i, x in enumerate(rows)}
    assert extras == {i: x[3:] for i, x in enumerate(rows) if len(x) > 3}
    assert tasks > 20 if size == 400 else tasks >= 1


def test_awkward_files(spark, tmp_path):
    cases = {"empty": "", "breaks": "\n\n\n", "header": "a,b", "broken header": '"a\nb",c\n1,2\n', "open quote": 'a,b\n1,"two\nlines', "one": "a\n1\n\n2\n"}
    for name, text in cases.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        source = tables.import_source(spark, str(path))
        expected = plain(text)
        assert source.headers == (expected[0] if expected else []), name
        got = [list(r)[1:] for r in source.df.orderBy("row_index").collect()]
        assert [[c.rstrip("\n") for c in r] for r in got] == [[c.rstrip("\n") for c in r] for r in expected[1:]], name


def test_rows_of_a_folder_are_numbered_in_path_order(spark, tmp_path):
    """Spark packs files by size; numbers go by path."""
    for name, low, high in (("b", 5, 305), ("a", 0, 5), ("c", 305, 345)):
        spark.range(low, high, 1, 1).write.parquet(f"{tmp_path}/x/{name}.parquet")
    df = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "x"))
    assert sorted((r.row_index, r.id) for r in tables.number_rows(df).collect()) == [(i, i) for i in range(345)]
