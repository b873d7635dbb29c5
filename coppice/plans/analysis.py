"""The whole run: mapping, records, similarity graph, clusters, themes, labels."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from coppice.operators import clusters as C
from coppice.operators.export import cluster_lookup, export_rows
from coppice.operators.features import MOST_DF
from coppice.operators.records import ROW, Mapping, ignored_row, judged_rows, split_judged, validate_mapping
from coppice.operators.similarity import linking_edges
from coppice.plans.progress import Progress, Reporter
from coppice.session import release, save, save_bucketed, ship

TURNS = 3  # of hashing the texts of a run: more of them take time and less disk; beyond these, other steps take more disk


@dataclass(frozen=True)
class Settings:
    """Smallest cluster, and the similarity of edges in percent, for clusters and for themes; whether no theme is left out."""

    minimum_cluster_size: int = 50
    similarity_percent: int = 42
    theme_similarity_percent: int = 58
    most_document_frequency: int = MOST_DF
    strategy: str = "collapse"
    all_themes: bool = False

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Timings:
    """Wall-clock milliseconds of the parts of a run."""

    import_ms: int = 0
    preprocessing_ms: int = 0
    clustering_ms: int = 0
    labeling_ms: int = 0
    export_ms: int = 0


@dataclass
class Run:
    """Everything a run gives, as DataFrames."""

    source: DataFrame
    headers: list[str]
    mapping: Mapping
    settings: Settings
    records: DataFrame
    ignored: DataFrame
    clusters: DataFrame  # cluster_id, label, size
    members: DataFrame  # cluster_id, row_index
    themes: DataFrame  # cluster_id, theme_id, label, size
    theme_rows: DataFrame  # cluster_id, theme_id, row_index
    unclustered: DataFrame  # row_index
    timings: Timings = field(default_factory=Timings)
    extras: DataFrame | None = None  # row_index, cells: what source rows hold beyond the headers
    counts: dict[str, int] = field(default_factory=dict)  # of the tables as they were written

    @property
    def columns(self) -> list[str]:
        return [c for c in self.source.columns if c != ROW]

    def export(self) -> DataFrame:
        lookup = save_bucketed(cluster_lookup(self.clusters, self.members, self.themes, self.theme_rows), "lookup", ROW)
        return export_rows(self.source, self.records, lookup, self.columns)

    def nested_clusters(self) -> DataFrame:
        """One row a cluster with its themes; members stay in long form, whatever the cluster's size."""
        themes = F.sort_array(F.collect_list(F.struct("theme_id", "label", "size"))).alias("themes")
        return self.clusters.join(self.themes.groupBy("cluster_id").agg(themes), "cluster_id", "left")


def cluster_records(
    records: DataFrame, settings: Settings, reporter: Reporter | None = None, counts: dict[str, int] | None = None, turns: int = 1
) -> dict[str, DataFrame]:
    """Clusters, members, themes and theme rows of records (row_index, analysis_text); members and theme rows in buckets of rows.

    Records of a saved table can be taken in ``turns``.
    """
    reporter = reporter or Reporter()
    reporter.stage(3)
    reporter.substep(4, 1, 1, "Joining records on shared terms")
    s = settings
    edges = save(linking_edges(records, s.similarity_percent, (), s.most_document_frequency, s.strategy, turns), "edges")
    reporter.substep(5, 1, 2, "Merging similarity edges")
    found, members = C.cluster_members(C.members_by_component(records, edges), s.minimum_cluster_size)
    clustered, listed = Observation(), Observation()
    found = save(found.observe(listed, F.count(F.lit(1)).alias("n")), "clusters")
    members = save_bucketed(members.observe(clustered, F.count(F.lit(1)).alias("n")), "members", ROW)
    if counts is not None:
        counts.update(clusters=listed.get["n"], clustered=clustered.get["n"])
    release(records.sparkSession)
    reporter.substep(5, 2, 2, "Sorting retained clusters")
    reporter.stage(6)
    labels = save(C.labelled(found.select("cluster_id", "size"), members, records, ("cluster_id",)), "cluster-labels")
    release(records.sparkSession)
    theme_rows = save_bucketed(
        C.theme_members(
            records,
            members,
            s.minimum_cluster_size,
            s.theme_similarity_percent,
            s.most_document_frequency,
            s.strategy,
            s.all_themes,
            turns if s.all_themes else 1,
        ),
        "theme-rows",
        ROW,
    )
    release(records.sparkSession)
    sizes = theme_rows.groupBy("cluster_id", "theme_id").agg(F.first("size").alias("size"))
    themes = C.labelled(sizes, theme_rows, records, ("cluster_id", "theme_id"))
    return {
        "clusters": labels,
        "members": members.select("cluster_id", ROW),
        "themes": save(themes, "theme-labels"),
        "theme_rows": theme_rows.select("cluster_id", "theme_id", ROW),
    }


def run_analysis(
    source: DataFrame,
    mapping: Mapping,
    settings: Settings | None = None,
    headers: Sequence[str] | None = None,
    listen: Callable[[Progress], None] | None = None,
    extras: DataFrame | None = None,
) -> Run:
    """Analyse a table with ``row_index`` and string columns; nothing of it is collected.

    ``extras`` (row_index, cells) are kept for the export alone.
    """
    spark = ship(source.sparkSession)
    settings, reporter = settings or Settings(), Reporter(listen, spark)
    columns = [c for c in source.columns if c != ROW]
    began = time.perf_counter()
    reporter.stage(1)
    validate_mapping(mapping, columns)
    reporter.stage(2)
    # the source is read once; cells, records and ignored rows are columns and rows of one table in buckets of rows
    cells, seen = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_cells"), Observation()
    judged = judged_rows(source, mapping, columns, cells)
    measured = judged.observe(seen, F.count_if(~ignored_row()).alias("processed"), F.count_if(ignored_row()).alias("ignored"))
    # a text that is its description as it stands is written once
    text, description = F.col("analysis_text"), F.coalesce(F.col("_cells").getField(columns[mapping.short_description]).cast("string"), F.lit(""))
    judged = save_bucketed(measured.withColumn("analysis_text", F.when(text != description, text)), "judged", ROW)
    release(spark)
    judged = judged.withColumn("analysis_text", F.coalesce(text, description))
    counts = dict(seen.get)
    source = judged.select(ROW, "_cells.*")
    records, ignored = split_judged(judged)
    timings = Timings(preprocessing_ms=int((time.perf_counter() - began) * 1000))
    began = time.perf_counter()
    found = cluster_records(records, settings, reporter, counts, TURNS)
    reporter.stage(7)
    loose = C.unclustered(records, found["members"])
    timings.clustering_ms = int((time.perf_counter() - began) * 1000)
    reporter.stage(8)
    return Run(source, list(headers or columns), mapping, settings, records, ignored, unclustered=loose, timings=timings, extras=extras, counts=counts, **found)
