"""Clusters from components, themes inside clusters, labels of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.text import normalize_text, sentence_case, tokens
from coppice.operators.components import connected_components
from coppice.operators.features import MOST_DF
from coppice.operators.records import ROW
from coppice.operators.similarity import linking_edges
from coppice.session import in_order, save

MOST_THEMED = 5000
MOST_THEMES = 10
KEYWORDS_ASKED, KEYWORDS_USED = 4, 3
LEAST_KEYWORD_BYTES = 3


def members_by_component(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (row_index, component) of every record, alone where it has no edge."""
    found = connected_components(edges)
    joined = records.select(ROW).join(found.withColumnRenamed("node", ROW), ROW, "left")
    return joined.select(ROW, F.coalesce("component", ROW).alias("component"))


def numbered(groups: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Number rows (keys, component, size) from 1 by size, largest first, then component; anew for each value of keys.

    Groups are sorted over partitions and ranks shifted by the rows of the parts before,
    so no task orders all groups, nor all of one key or of one size.
    """
    placed, _ = in_order(groups.withColumn("_least", -F.col("size")), *keys, "_least", "component")
    parts = placed.groupBy("_part", *keys).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part and key
    starts = parts.select("_part", *keys, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_before"))
    number = (F.col("_before") + F.col("_at") + 1).cast("long")
    return placed.join(starts, ["_part", *keys]).withColumn(name, number).select(*groups.columns, name)


def cluster_members(members: DataFrame, minimum: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster_id, component, size) and members (cluster_id, row_index) of components large enough."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= minimum)
    clusters = numbered(sizes, "cluster_id")
    return clusters, members.join(clusters, "component").select("cluster_id", ROW, "size")


def unclustered(records: DataFrame, members: DataFrame) -> DataFrame:
    return records.join(members, ROW, "left_anti").select(ROW)


def keywords(members: DataFrame, records: DataFrame, keys: tuple[str, ...], limit: int = KEYWORDS_ASKED) -> DataFrame:
    """Rows (keys, rank, keyword, occurrences): most frequent words of each group, ties by word."""
    words = F.filter(
        tokens(normalize_text(F.col("analysis_text"))), lambda t: F.octet_length(t) >= LEAST_KEYWORD_BYTES
    )
    spelled = members.select(*keys, ROW).join(records.select(ROW, F.explode(words).alias("keyword")), ROW)
    counted = spelled.groupBy(*keys, "keyword").agg(F.count("*").alias("occurrences"))
    order = Window.partitionBy(*keys).orderBy(F.desc("occurrences"), "keyword")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def label_of(first: Column, second: Column, third: Column, cluster_id: Column) -> Column:
    text = (
        F.when(first.isNull(), F.concat(F.lit("Similar incidents in cluster "), cluster_id.cast("string")))
        .when(second.isNull(), first)
        .when(third.isNull(), F.concat(first, F.lit(" related to "), second))
        .otherwise(F.concat(first, F.lit(" issues involving "), second, F.lit(" and "), third))
    )
    return sentence_case(text)


def labelled(groups: DataFrame, members: DataFrame, records: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``groups`` (keys, size) with a label; the fallback names the cluster, for themes too."""
    ranked = keywords(members, records, keys)
    words = [F.max(F.when(F.col("rank") == k, F.col("keyword"))).alias(f"w{k}") for k in range(1, KEYWORDS_USED + 1)]
    named = groups.join(ranked.groupBy(*keys).agg(*words), list(keys), "left")
    label = label_of(F.col("w1"), F.col("w2"), F.col("w3"), F.col("cluster_id"))
    return named.select(*keys, label.alias("label"), "size")


def theme_members(
    records: DataFrame,
    members: DataFrame,
    minimum: int,
    percent: int,
    most_df: int = MOST_DF,
    strategy: str = "overlap",
    all_themes: bool = False,
    turns: int = 1,
) -> DataFrame:
    """Rows (cluster_id, theme_id, row_index, size) of the themes of each cluster.

    All clusters are one job: terms, frequencies and edges are keyed by cluster.
    Clusters not above the minimum are one theme.  Without ``all_themes`` a cluster keeps its
    ``MOST_THEMES`` largest themes, and one above ``MOST_THEMED`` is one theme; with it, each
    row of a cluster is in a theme, whatever its size.  ``turns`` as for ``saved_term_sets``.
    """
    split = F.col("size") > minimum
    if not all_themes:
        split &= F.col("size") <= MOST_THEMED
    inside = save(
        members.where(split).join(records.select(ROW, "analysis_text"), ROW).select("cluster_id", ROW, "analysis_text"),
        "theme-records",
    )
    edges = linking_edges(inside, percent, ("cluster_id",), most_df, strategy, turns)
    parts = inside.select("cluster_id", ROW).join(members_by_component(inside, edges), ROW)
    sizes = parts.groupBy("cluster_id", "component").agg(F.count("*").alias("size"))
    listed = numbered(sizes, "theme_id", ("cluster_id",))
    if not all_themes:
        listed = listed.where(F.col("theme_id") <= MOST_THEMES)
    themed = parts.join(listed, ["cluster_id", "component"]).select("cluster_id", "theme_id", ROW, "size")
    whole = members.where(~split).select("cluster_id", F.lit(1).cast("long").alias("theme_id"), ROW, "size")
    return themed.unionByName(whole)
