"""Reading tables of strings with numbered rows."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.operators.records import ROW
from coppice.session import save, ship
from coppice.sources import xlsx
from coppice.sources.csvsplit import read_records

EXCEL = {".xlsx", ".xlsm", ".xls"}


class UnsupportedSource(ValueError):
    """A file of a kind that isn't read."""


class UnreadableRecord(ValueError):
    """A record of a file that isn't UTF-8."""


@dataclass
class Source:
    """A table: ``row_index`` and one string column a header, named by position (headers may repeat)."""

    df: DataFrame
    headers: list[str]
    path: str | None = None
    worksheet: str | None = None
    extras: DataFrame | None = None  # row_index, cells: what rows hold beyond the header

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.headers))]

    @property
    def row_count(self) -> int:
        return self.df.count()


def suffix(path: str) -> str:
    return Path(path.rsplit("/", 1)[-1]).suffix.lower()


def is_excel(path: str) -> bool:
    return suffix(path) in EXCEL


def import_source(spark: SparkSession, path: str, sep: str = ",") -> Source:
    """CSV, or the first sheet of a workbook, by the file's extension."""
    if suffix(path) == ".csv":
        return import_csv(spark, path, sep)
    if is_excel(path):
        sheets = list_worksheets(spark, path)
        if not sheets:
            raise UnsupportedSource("workbook does not contain worksheets")
        return import_sheet(spark, path, sheets[0])
    raise UnsupportedSource("unsupported input file type")


def import_csv(spark: SparkSession, path: str, sep: str = ",") -> Source:
    """All cells as strings; short rows end in empty cells, cells beyond the header are in ``extras``.

    ``path`` may be a folder of files with the same header.  Large files are read in many
    tasks, line breaks inside quotes or not.  Bytes that aren't UTF-8 fail the import.
    """
    records, headers, fine = read_records(ship(spark), path, sep)
    if not fine:
        raise UnreadableRecord(f"failed to read CSV record of {path}: invalid UTF-8")
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(headers))]
    beyond = F.slice("cells", len(headers) + 1, F.greatest(F.size("cells") - len(headers), F.lit(0)))
    extras = records.where(F.size("cells") > len(headers)).select(ROW, beyond.alias("cells"))
    return Source(records.select(ROW, *cells), headers, path, extras=extras if headers else None)


def number_rows(df: DataFrame) -> DataFrame:
    """0-based contiguous ``row_index`` of a table as it was read: by file path, block and place in it.

    A table that isn't read from files is numbered by partition.  Written once, so that the
    rows that are counted are the rows that are numbered; one count a block is brought together.
    """
    try:
        place = [df["_metadata.file_path"].alias("_file"), df["_metadata.file_block_start"].alias("_block")]
        df.select(*place)
    except AnalysisException:
        place = [F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_block")]
    marked = save(df.select("*", *place, F.monotonically_increasing_id().alias("_m")), "numbered")
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_m").alias("_least"))
    starts = counts.select("_file", "_block", "_least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    numbered = marked.join(starts, ["_file", "_block"]).withColumn(ROW, F.col("_start") + F.col("_m") - F.col("_least"))
    return numbered.select(ROW, *df.columns)


def counts_of(df: DataFrame) -> DataFrame:
    """One row: how many rows and columns a numbered table has."""
    return df.agg(F.count("*").alias("row_count"), F.lit(len(df.columns) - 1).cast("long").alias("column_count"))


def list_worksheets(spark: SparkSession, path: str) -> list[str]:
    return xlsx.sheet_names(xlsx.file_bytes(spark, path))


def import_sheet(spark: SparkSession, path: str, sheet: str) -> Source:
    """A named sheet: the first row with a value is the header, cells become strings.

    The table is as wide as the columns that hold a value in any row; headers may be empty.
    """
    headers, first = xlsx.header_of(ship(spark), path, sheet)
    return Source(xlsx.read_sheet(spark, path, sheet, first, len(headers)), headers, path, sheet)


def default_export_path(source_path: str | None) -> str:
    if source_path is None:
        return "clustered_incidents.xlsx"
    path = Path(source_path)
    return str(path.with_name(f"{path.stem or 'incidents'}_clustered.xlsx"))
