"""Exploring results: facets, filters, counts, details."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.text import blank_display, contains_ignoring_case
from coppice.operators.records import ROW

DETAIL_ROWS = 250
PREVIEW_ROWS = 25


@dataclass
class FacetFilter:
    """What is selected in each column; a column without an entry is unrestricted."""

    selected: dict[str, set[str]] = field(default_factory=dict)
    search: dict[str, str] = field(default_factory=dict)

    @property
    def active_count(self) -> int:
        return len(self.selected)

    def clear(self) -> None:
        self.selected.clear()
        self.search.clear()

    def selected_count(self, column: str, total: int) -> int:
        return len(self.selected[column]) if column in self.selected else total

    def is_selected(self, column: str, value: str) -> bool:
        return column not in self.selected or value in self.selected[column]

    def select_all(self, column: str) -> None:
        self.selected.pop(column, None)

    def select_none(self, column: str) -> None:
        self.selected[column] = set()

    def set_selected(self, column: str, value: str, on: bool, values: Iterable[str]) -> None:
        """Switch one value; a column with every value selected is unrestricted again."""
        values = set(values)
        chosen = self.selected.setdefault(column, set(values))
        (chosen.add if on else chosen.discard)(value)
        if len(chosen) == len(values):
            del self.selected[column]

    def search_for(self, column: str, term: str) -> None:
        """Typing into an unrestricted column first deselects all of it; an empty term stops the search."""
        if not term:
            self.search.pop(column, None)
            return
        self.selected.setdefault(column, set())
        self.search[column] = term

    def condition(self, columns: Sequence[str]) -> Column:
        """AND over columns of value in set; a missing cell is empty, a missing column is empty everywhere."""

        def one(column: str, values: set[str]) -> Column:
            if column not in columns:
                return F.lit("" in values)
            if not values:
                return F.lit(False)
            return F.coalesce(F.col(f"`{column}`"), F.lit("")).isin(sorted(values))

        return reduce(Column.__and__, (one(c, v) for c, v in self.selected.items()), F.lit(True))

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.condition(rows.columns))


def processed_rows(source: DataFrame, records: DataFrame) -> DataFrame:
    return source.join(records.select(ROW), ROW, "left_semi")


def filtered_count(source: DataFrame, records: DataFrame, filters: FacetFilter) -> DataFrame:
    return filters.apply(processed_rows(source, records)).agg(F.count("*").alias("visible"))


def filtered_members(members: DataFrame, source: DataFrame, filters: FacetFilter) -> DataFrame:
    return members.join(filters.apply(source).select(ROW), ROW, "left_semi")


def filtered_group_counts(members: DataFrame, source: DataFrame, filters: FacetFilter, keys: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Groups with visible rows and how many; groups without any disappear."""
    return filtered_members(members, source, filters).groupBy(*keys).agg(F.count("*").alias("visible"))


def facet_values(source: DataFrame, records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, value, display): distinct values of processed rows, blank included, filters or not."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in columns])
    found = processed_rows(source, records).select(F.explode(cells).alias("cell")).select("cell.*").distinct()
    return found.withColumn("display", blank_display(F.col("value")))


def facet_search(values: DataFrame, term: str) -> DataFrame:
    """Facet values that contain the term in any case; an empty term keeps all."""
    return values.where(contains_ignoring_case(F.col("value"), term))


def theme_details(theme_rows: DataFrame, limit: int = DETAIL_ROWS) -> DataFrame:
    """The first rows of each theme in source order, with their place."""
    order = Window.partitionBy("cluster_id", "theme_id").orderBy(ROW)
    return theme_rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def source_preview(source: DataFrame, limit: int = PREVIEW_ROWS) -> DataFrame:
    cells = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in source.columns if c != ROW}
    return source.orderBy(ROW).limit(limit).withColumns(cells)


def run_summary(records: DataFrame, visible: DataFrame, ignored: DataFrame, clusters: DataFrame, loose: DataFrame) -> DataFrame:
    """One row of five counts."""
    parts = {"processed": records, "visible": visible, "ignored": ignored, "clusters": clusters, "unclustered": loose}
    rows = [df.select(F.lit(name).alias("name")) for name, df in parts.items()]
    sums = [F.sum((F.col("name") == name).cast("long")).alias(name) for name in parts]
    counted = reduce(DataFrame.unionByName, rows).agg(*sums)
    return counted.select(*[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in parts])


def summary_of_run(counts: dict[str, int], visible: DataFrame) -> DataFrame:
    """The same row from the counts that a run took as it wrote its tables; only what is visible is counted now."""
    known = {"processed": counts["processed"], "ignored": counts["ignored"], "clusters": counts["clusters"], "unclustered": counts["processed"] - counts["clustered"]}
    counted = visible.agg(F.count("*").alias("visible"))
    return counted.select(*[F.col(c) if c == "visible" else F.lit(known[c]).cast("long").alias(c) for c in ("processed", "visible", "ignored", "clusters", "unclustered")])


def result_tree(clusters: DataFrame, themes: DataFrame, theme_rows: DataFrame) -> DataFrame:
    """Rows of clusters (level 0), themes (1) and records (2); rows in no theme aren't shown.

    Display order is cluster_id, theme_id, row_index: a cluster has theme 0, a heading row -1.
    """
    none = F.lit(-1).cast("long").alias(ROW)
    top = clusters.select("cluster_id", F.lit(0).cast("long").alias("theme_id"), none, "label", "size", F.lit(0).alias("level"))
    middle = themes.select("cluster_id", "theme_id", none, "label", "size", F.lit(1).alias("level"))
    one = F.lit(1).cast("long").alias("size")
    leaves = theme_rows.select("cluster_id", "theme_id", ROW, F.lit("").alias("label"), one, F.lit(2).alias("level"))
    return top.unionByName(middle).unionByName(leaves)


# ---------------------------------------------------------------- extras that are only documented


def date_range(records: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Extra: records with a date inside the closed range; an open end is unrestricted."""
    kept = records
    if first is not None:
        kept = kept.where(F.col("parsed_date") >= F.lit(first).cast("date"))
    if last is not None:
        kept = kept.where(F.col("parsed_date") <= F.lit(last).cast("date"))
    return kept


def unparsed_dates(records: DataFrame) -> DataFrame:
    """Extra: how many records have no date."""
    return records.agg(F.count_if(F.col("parsed_date").isNull()).alias("unparsed"))


def ignored_reasons(ignored: DataFrame) -> DataFrame:
    """Extra: ignored rows by reason."""
    keys = ("missing_incident_number", "missing_short_description")
    return ignored.groupBy(*keys).agg(F.count("*").alias("n"))
