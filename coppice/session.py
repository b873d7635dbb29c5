"""What every plan needs from the session: shared scratch space and worker imports."""

from __future__ import annotations

import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch: with long texts Spark's own 64 MB make buffers of that size, and copies, in every task.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")
CODEC = "zstd"  # of tables in the shared folder: texts take about two thirds of what they take in Spark's usual one
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even when the driver found it by sys.path.

    Arrow batches are made smaller where the session leaves their size at Spark's own.
    """
    name, usual, smaller = ARROW_BYTES
    if spark.conf.get(name) == usual:
        spark.conf.set(name, smaller)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, one in the warehouse, which is shared as well."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, over all cores where its files give fewer parts; a large one stays as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def in_order(df: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """``df`` sorted over partitions, with ``_part`` and 0-based ``_at`` inside it, and rows (_part, n).

    Written first, so every later read sees the same parts; no task orders all rows.
    """
    sort = [F.col(c) for c in order]
    mark = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_m", mark)
    part, at = F.shiftright("_m", 33).alias("_part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")
    placed = save(placed.select(*df.columns, part, at), "in-order")
    return placed, placed.groupBy("_part").agg(F.count("*").alias("n"))


def save(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it back.

    Unlike a local checkpoint the table outlives lost executors. ``forget`` drops it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/coppice/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=CODEC)
    out = spark.read.schema(df.schema).parquet(path)
    out._coppice_path = path
    return out


def save_bucketed(df: DataFrame, tag: str, key: str, ordered: bool = True) -> DataFrame:
    """Like ``save``, as a table in as many buckets of ``key`` as a shuffle has parts, each sorted by it unless not ``ordered``.

    Tables saved so join on ``key`` where they lie: nothing is exchanged.
    """
    spark, name = df.sparkSession, f"coppice_{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    path, n = f"{scratch_root(spark)}/coppice/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(n, key).write.format("parquet").option("compression", CODEC).bucketBy(n, key).option("path", path)
    (writer.sortBy(key) if ordered else writer).saveAsTable(name)
    out = spark.table(name)
    out._coppice_path, out._coppice_table = path, name
    return out


def release(spark: SparkSession) -> None:
    """Give back the shuffle files of finished steps: Spark deletes them once the driver's garbage is collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*frames: DataFrame | None) -> None:
    """Delete tables written by ``save`` and ``save_bucketed`` once nothing lazy reads them any more."""
    for df in frames:
        path = getattr(df, "_coppice_path", None)
        if path is None:
            continue
        if name := getattr(df, "_coppice_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
