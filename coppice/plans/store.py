"""Saved mappings and runs: a JSON manifest beside one Parquet table a part.

Everything goes through the file system that the path names, so a run may be
saved wherever the cluster can write.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from coppice.operators.export import METADATA, METADATA_HEADERS
from coppice.operators.records import ROW, Mapping
from coppice.plans.analysis import Run, Settings, Timings
from coppice.session import save
from coppice.sources.xlsx import write_workbook

VERSION = 1
FURTHER_CELLS = "Further Cells"
TABLES = ("source", "records", "ignored", "clusters", "members", "themes", "theme_rows", "unclustered")


def save_mapping(path: str, mapping: Mapping) -> None:
    text = json.dumps({"version": VERSION, "mapping": mapping.to_dict()}, indent=2)
    Path(path).write_text(text, encoding="utf-8")


def load_mapping(path: str) -> Mapping:
    """The version is kept for readers to come; any is accepted."""
    try:
        return Mapping.from_dict(json.loads(Path(path).read_text(encoding="utf-8"))["mapping"])
    except (OSError, ValueError, KeyError) as error:
        raise ValueError(f"failed to read {path}") from error


def save_run(path: str, run: Run) -> None:
    spark = run.source.sparkSession
    for name in TABLES:
        getattr(run, name).write.mode("overwrite").parquet(f"{path}/{name}")
    if run.extras is not None:
        run.extras.write.mode("overwrite").parquet(f"{path}/extras")
    manifest = {
        "version": VERSION,
        "extras": run.extras is not None,
        "headers": run.headers,
        "mapping": run.mapping.to_dict(),
        "settings": run.settings.to_dict(),
        "timings": asdict(run.timings),
        "counts": run.counts,
    }
    # written last: a folder with a manifest is a whole session
    line = spark.createDataFrame([(json.dumps(manifest),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_run(spark: SparkSession, path: str) -> Run:
    """A saved run, without the original file and without computing anything again."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    return Run(
        headers=manifest["headers"],
        mapping=Mapping.from_dict(manifest["mapping"]),
        settings=Settings(**manifest["settings"]),
        timings=Timings(**manifest["timings"]),
        counts=manifest.get("counts", {}),
        extras=spark.read.parquet(f"{path}/extras") if manifest.get("extras") else None,
        **tables,
    )


#: The layout of a session that is one JSON document.
JSON_INDEX = "source_row_index long"
JSON_ROLES = "incident_number int, short_description int, additional_text array<int>, assignment_group int, service int, category int, configuration_item int, date int"
JSON_FILTERS = "assignment_group string, service string, category string, configuration_item string"
JSON_GROUP = "id long, label string, incident_row_indices array<long>"
JSON_RUN = f"""run struct<source struct<headers array<string>, rows array<array<string>>>, mapping struct<{JSON_ROLES}>,
  settings struct<minimum_cluster_size int, similarity_threshold_percent int, subgroup_similarity_threshold_percent int>,
  processed_incidents array<struct<{JSON_INDEX}, incident_number string, analysis_text string, filter_values struct<{JSON_FILTERS}>, parsed_date date>>,
  ignored_rows array<struct<{JSON_INDEX}, missing_incident_number boolean, missing_short_description boolean>>,
  clusters array<struct<{JSON_GROUP}, subgroups array<struct<{JSON_GROUP}>>>>, unclustered_row_indices array<long>,
  timings struct<import_ms long, preprocessing_ms long, clustering_ms long, labeling_ms long, export_ms long>>"""


def load_json_run(spark: SparkSession, path: str) -> Run:
    """A session saved as one JSON document with its whole source inside."""
    run = save(spark.read.schema(JSON_RUN).json(path, multiLine=True, mode="FAILFAST").select("run.*"), "json-run")
    head = run.select("source.headers", "mapping", "settings", "timings").first()
    if head is None or head.headers is None:
        raise ValueError(f"failed to read {path}")
    s, width = head.settings, len(head.headers)
    cells = run.select(F.posexplode("source.rows").alias("at", "x"))
    each = lambda name: run.select(F.explode(name).alias("x"))
    groups = each("clusters").select(F.col("x.id").alias("cluster_id"), "x.label", "x.incident_row_indices", "x.subgroups")
    themes = groups.select("cluster_id", F.explode("subgroups").alias("x")).select("cluster_id", F.col("x.id").alias("theme_id"), "x.label", "x.incident_row_indices")
    size = F.size("incident_row_indices").cast("long").alias("size")
    rows = F.explode("incident_row_indices").alias(ROW)
    return Run(
        source=cells.select(F.col("at").cast("long").alias(ROW), *[F.coalesce(F.try_element_at("x", F.lit(i + 1)), F.lit("")).alias(f"c{i}") for i in range(width)]),
        headers=head.headers,
        mapping=Mapping.from_dict(head.mapping.asDict()),
        settings=Settings(s.minimum_cluster_size, s.similarity_threshold_percent, s.subgroup_similarity_threshold_percent),
        records=each("processed_incidents").select(F.col("x.source_row_index").alias(ROW), "x.incident_number", "x.analysis_text", "x.filter_values.*", "x.parsed_date"),
        ignored=each("ignored_rows").select(F.col("x.source_row_index").alias(ROW), "x.missing_incident_number", "x.missing_short_description"),
        clusters=groups.select("cluster_id", "label", size),
        members=groups.select("cluster_id", rows),
        themes=themes.select("cluster_id", "theme_id", "label", size),
        theme_rows=themes.select("cluster_id", "theme_id", rows),
        unclustered=run.select(F.explode("unclustered_row_indices").alias(ROW)),
        timings=Timings(**head.timings.asDict()),
        extras=cells.where(F.size("x") > width).select(F.col("at").cast("long").alias(ROW), F.slice("x", width + 1, F.size("x")).alias("cells")),
    )


def distinct_names(headers: Sequence[str]) -> list[str]:
    """Headers as column names that differ in any case: a repeated one gets its number, an empty one its place."""
    taken: set[str] = set()
    out = []
    for place, header in enumerate(headers, 1):
        base, n = header or f"Column {place}", 1
        name = base
        while name.lower() in taken:
            n += 1
            name = f"{base} ({n})"
        taken.add(name.lower())
        out.append(name)
    return out


def export_table(run: Run, path: str, kind: str = "parquet") -> None:
    """The export in any format Spark writes, in parallel, in source order.

    Columns carry the headers; a repeated header is numbered.  Cells beyond the headers that
    a workbook would keep come last, as a JSON array in a column of their own.
    """
    rows, columns, headers = run.export(), [*run.columns, *METADATA], [*run.headers, *METADATA_HEADERS]
    if run.extras is not None:
        past = F.to_json(F.slice("cells", len(METADATA) + 1, F.size("cells"))).alias("_past")
        rows = rows.join(run.extras.where(F.size("cells") > len(METADATA)).select(ROW, past), ROW, "left")
        columns, headers = [*columns, "_past"], [*headers, FURTHER_CELLS]
    renamed = [F.col(f"`{c}`").alias(h) for c, h in zip(columns, distinct_names(headers), strict=True)]
    writer = rows.select(ROW, *renamed).sort(ROW).drop(ROW).write.mode("overwrite")
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(path)


def export_workbook(run: Run, path: str) -> int:
    """One workbook in source order, streamed to the driver a partition at a time; its rows are bounded by the format.

    Cells beyond the headers keep their places; the six added columns take the first of them.
    """
    headers, rows = [*run.headers, *METADATA_HEADERS], run.export()
    if run.extras is None:
        return write_workbook(path, headers, rows.sort(ROW).drop(ROW).toLocalIterator(prefetchPartitions=True))
    past = run.extras.select(ROW, F.slice("cells", len(METADATA) + 1, F.size("cells")).alias("_past"))
    wide = rows.join(past, ROW, "left").sort(ROW).drop(ROW).toLocalIterator(prefetchPartitions=True)
    return write_workbook(path, headers, ([*values, *(past or ())] for *values, past in wide))
