"""Histogram sort into byte-balanced shards.

Rows are ordered by (hash of the text, id).  The driver asks for the exact bytes
below a few thousand candidate boundaries at a time, narrows every splitter to
one bucket, and repeats until each splitter's exact byte count is within the
tolerance of its target; only then do rows move, once.  Equal texts are adjacent
in this order, so a group of copies is cut only where one shard could not hold
it: a splitter that falls inside one hash is refined over ids.

Everything is DataFrame code; the driver sees bounded histograms only.
Null texts count as empty (size 1), null ids sort first, ids that aren't whole
numbers are ordered by hash, repeated rows are all kept, an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.llm.common import table
from coppice.session import save, spread

KEY_BITS = 62
FIRST_BITS = 12
PROBE_BITS = 10
RANK_SALTS, SALT_ROWS = 16, 1 << 20
GROUP_TOLERANCE = 10  # times the tolerance, before equal texts are parted
NO_ID = -(2**61)


@dataclass
class Splitter:
    """A boundary being narrowed: rows below (key, id) belong to earlier shards."""

    target: float
    key: int | None = None  # set once the splitter lies inside one hash
    low: int = 0
    high: int = 1 << KEY_BITS
    below: int = 0  # exact bytes below ``low``
    done: bool = False


def shard_by_bytes(
    df: DataFrame, text: str = "text", id_col: str = "doc_id", shards: int = 16, tolerance: float = 0.001
) -> DataFrame:
    """Columns id, size, text_crc32, shard, slot: near equal bytes in every shard.

    ``tolerance``: how far a boundary may be from its target, as a share of one shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col("_id").cast("long") if whole else F.when(F.col("_id").isNotNull(), F.xxhash64(F.col("_id").cast("string")))
    rows = save(
        df.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(F.col(text)).cast("long")).alias("_octets"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 64 - KEY_BITS).alias("_key"),
        ).withColumns(
            {
                "size": F.coalesce(F.col("_octets"), F.lit(0)) + F.lit(1).cast("long"),
                # ids beyond the bounds share a rank, so that a difference of two ranks fits 64 bits
                "_rank": F.coalesce(
                    F.greatest(F.least(number, F.lit(-NO_ID)), F.lit(NO_ID)), F.lit(NO_ID)
                ),
                "_n": F.monotonically_increasing_id(),  # written with the row, so it stays
            }
        ).drop("_octets"),
        "shard-keys",
    )
    splitters = find_splitters(rows, shards, tolerance)
    shard = reduce(lambda a, b: a + b, (at_or_above(s).cast("int") for s in splitters), F.lit(0))
    placed = rows.withColumns({"shard": shard, "_part": rank_part(max(RANK_SALTS, rows.count() // SALT_ROWS))})
    return with_slots(placed).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def at_or_above(s: Splitter) -> Column:
    if s.key is None:
        return F.col("_key") >= s.low
    return (F.col("_key") > s.key) | ((F.col("_key") == s.key) & (F.col("_rank") >= s.low))


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack, group_slack = max(total / shards * tolerance, 1), total / shards * tolerance * GROUP_TOLERANCE
    splitters = [Splitter(total * i / shards) for i in range(1, shards)]
    bits = FIRST_BITS
    while pending := [s for s in splitters if not s.done]:
        spans = sorted({(s.key, s.low, s.high) for s in pending}, key=lambda x: (x[0] or 0, x[1]))
        counted = histogram(rows, spans, bits)
        for s in pending:
            narrow(s, counted[s.key, s.low, s.high], slack, group_slack)
        inside = {s.low for s in pending if not s.done and s.key is None and s.high - s.low == 1}
        if inside:
            to_ids(rows, pending, inside)
        bits = PROBE_BITS
    return splitters


def histogram(rows: DataFrame, spans: list[tuple], bits: int) -> dict[tuple, tuple[int, list[tuple[int, int]]]]:
    """For each span: the probes' distance and, for its buckets with rows, (bucket, exact bytes)."""
    steps = [max(1, -(-(high - low) >> bits)) for _, low, high in spans]
    which, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, ((key, low, high), step) in reversed(list(enumerate(zip(spans, steps, strict=True)))):
        at = F.col("_key") if key is None else F.col("_rank")
        inside = (at >= low) & (at < high)
        if key is not None:
            inside &= F.col("_key") == key
        which = F.when(inside, F.lit(i)).otherwise(which)
        cell = F.expr(f"({'_key' if key is None else '_rank'} - ({low}L)) div {step}L")
        bucket = F.when(inside, cell).otherwise(bucket)
    got = (
        rows.select(which.alias("w"), bucket.alias("b"), "size")
        .where("w is not null")
        .groupBy("w", "b")
        .agg(F.sum("size").alias("n"))
        .orderBy("w", "b")
        .collect()
    )
    out = {span: (step, []) for span, step in zip(spans, steps, strict=True)}
    for w, b, n in got:
        out[spans[w]][1].append((b, n))
    return out


def narrow(s: Splitter, counted: tuple[int, list[tuple[int, int]]], slack: float, group_slack: float) -> None:
    """Move to the bucket that holds the target, or settle on an edge that is close enough."""
    step, buckets = counted
    low, below = s.low, s.below
    for b, n in buckets:
        if below + n < s.target:
            below += n
            continue
        start, end = low + b * step, min(low + (b + 1) * step, s.high)
        under, over = s.target - below, below + n - s.target
        # a group of equal texts isn't cut for the sake of a hundredth of a shard
        whole = max(slack, group_slack) if s.key is None and end - start == 1 else slack
        if min(under, over) <= whole or (s.key is not None and end - start == 1):
            s.low, s.below = (start, below) if under <= over else (end, below + n)
            s.done = True
        else:
            s.low, s.high, s.below = start, end, below
        return
    s.low, s.below, s.done = s.high, below, True


def to_ids(rows: DataFrame, pending: list[Splitter], keys: set[int]) -> None:
    """Splitters inside one hash go on over the ids of the rows that share it."""
    spans = {
        k: (lo, hi)
        for k, lo, hi in rows.where(F.col("_key").isin(sorted(keys)))
        .groupBy("_key")
        .agg(F.min("_rank"), F.max("_rank"))
        .collect()
    }
    for s in pending:
        if not s.done and s.key is None and s.high - s.low == 1:
            s.key, (lo, hi) = s.low, spans[s.low]
            s.low, s.high = lo, hi + 1


def rank_part(salts: int) -> Column:
    """Ranks are counted in many small parts: a slice of the key range, salted for hot keys, with ids or without."""
    slice_ = F.shiftright(F.col("_key"), KEY_BITS - FIRST_BITS)
    return slice_ * salts + F.pmod(F.xxhash64("_n"), F.lit(salts))


def with_slots(placed: DataFrame) -> DataFrame:
    """A gapless slot in each shard: ranks inside parts plus the rows of the parts before."""
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    starts = parts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_part").orderBy("_key", "_rank", "size", "_n")
    ranked = placed.withColumn("_at", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_at"))


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spread(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
