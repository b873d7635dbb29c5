"""Records back to their source rows with cluster and theme columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.functions.text import cluster_code
from coppice.operators.records import ROW

#: Headers of the appended columns, in order.
METADATA_HEADERS = ("Cluster ID", "Cluster Label", "Cluster Size", "Theme ID", "Theme Label", "Theme Size")
METADATA = ("cluster_code", "cluster_label", "cluster_size", "theme_code", "theme_label", "theme_size")


def cluster_lookup(clusters: DataFrame, members: DataFrame, themes: DataFrame, theme_rows: DataFrame) -> DataFrame:
    """Rows (row_index, metadata): a row in no listed theme keeps its cluster and has blank theme fields."""
    own = members.select("cluster_id", ROW).join(
        clusters.select("cluster_id", F.col("label").alias("cluster_label"), F.col("size").alias("cluster_size")), "cluster_id"
    )
    named = theme_rows.select("cluster_id", "theme_id", ROW).join(
        themes.select("cluster_id", "theme_id", F.col("label").alias("theme_label"), F.col("size").alias("theme_size")),
        ["cluster_id", "theme_id"],
    )
    return own.join(named, ["cluster_id", ROW], "left").select(
        ROW,
        cluster_code(F.col("cluster_id")).alias("cluster_code"),
        "cluster_label",
        "cluster_size",
        F.coalesce(F.col("theme_id").cast("string"), F.lit("")).alias("theme_code"),
        F.coalesce("theme_label", F.lit("")).alias("theme_label"),
        F.coalesce("theme_size", F.lit(0)).cast("long").alias("theme_size"),
    )


def with_metadata(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Left join with what unclustered rows get."""
    absent = {"cluster_code": "Unclustered", "cluster_label": "Unclustered", "theme_code": "", "theme_label": ""}
    joined = rows.join(lookup, ROW, "left")
    filled = {c: F.coalesce(F.col(c), F.lit(absent[c]) if c in absent else F.lit(0).cast("long")) for c in METADATA}
    return joined.withColumns(filled)


def export_rows(source: DataFrame, records: DataFrame, lookup: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Source rows of processed records with six more columns; ``row_index`` keeps their order."""
    columns = list(columns or [c for c in source.columns if c != ROW])
    kept = source.select(ROW, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns])
    return with_metadata(kept.join(records.select(ROW), ROW, "left_semi"), lookup).select(ROW, *columns, *METADATA)
