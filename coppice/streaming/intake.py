"""Records from arriving files: the row-wise part of a run works on streams as it is.

Each batch is read once and written once, valid records and ignored rows side by side,
in a folder of the batch's number.  A batch that is run again after a failure replaces its
folder, so every row is there exactly once.  Clusters depend on document frequencies over
all records, so they are computed by a batch run over what the intake has written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coppice.operators.records import ROW, Mapping, ignored_row, judged_rows, split_judged, validate_mapping


def write_batch(judged: DataFrame, path: str, number: int) -> None:
    side = F.when(ignored_row(), "ignored").otherwise("records").alias("side")
    judged.select("*", side).write.mode("overwrite").partitionBy("side").parquet(f"{path}/batch={number}")


def stream_records(arriving: DataFrame, mapping: Mapping, path: str, checkpoint: str, columns: Sequence[str] | None = None) -> StreamingQuery:
    """Write valid records and ignored rows of a stream with ``row_index`` under ``path``, exactly once each."""
    columns = list(columns or [c for c in arriving.columns if c != ROW])
    validate_mapping(mapping, columns)
    writer = judged_rows(arriving, mapping, columns).writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(lambda batch, number: write_batch(batch, path, number)).start()


def written_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid records and ignored rows of all batches; each side reads its own files only."""
    found = spark.read.parquet(path)
    records, _ = split_judged(found.where("side = 'records'"))
    _, ignored = split_judged(found.where("side = 'ignored'"))
    return records, ignored
