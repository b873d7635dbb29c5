"""Best-fit packing planned on the histogram of piece lengths.

1. Every document becomes pieces of at most ``capacity`` tokens (one Arrow pass;
   the piece table holds numbers only and is written once).
2. The driver gets the histogram of lengths, at most ``capacity`` rows at any
   input size, and runs best-fit decreasing over counts: one step places up to
   all open sequences with the same room at once.
3. Pieces that fill a sequence take one each, where they are.  Any other gets its
   rank among the pieces of its length (counted in parts of bounded size, so that one
   very common length is no single task) and takes the planned slot with that rank.

Null and empty texts are one end token; repeated rows, and rows without an id, are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, table
from coppice.llm.tokens import BpeEncoder
from coppice.session import save, spread

CAPACITY = 2048
END_ID = 0
PART_ROWS = 1 << 18  # about so many pieces of one length are ranked in one task
RANK_BITS = 40


def pieces_of(df: DataFrame, tokenizer: str, text: str, id_col: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, _n); the first piece of a long document takes the rest.

    ``_n`` is any number, spread evenly.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = BpeEncoder.of(tokenizer)
        end = END_ID.to_bytes(4, "little")
        rows, piece, start, length, crc = [], [], [], [], []
        for i, value in enumerate(batch.column(1).to_pylist()):
            ids = encoder.encode_bytes(value or "") + end
            n = len(ids) // 4
            at, upto, k = 0, n % capacity or min(n, capacity), 0
            while at < n:
                rows.append(i)
                piece.append(k)
                start.append(at)
                length.append(upto - at)
                crc.append(zlib.crc32(ids[4 * at : 4 * upto]))
                at, upto, k = upto, upto + capacity, k + 1
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
        columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
        columns.append(pa.array(np.arange(len(rows), dtype=np.int32)))
        return pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "_n"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _n int"
    return arrow_map(df.select(id_col, text), cut, schema)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts; rows (length, first rank, count, first sequence, offset).

    Sequences with the same room are runs of consecutive numbers, and a step
    places a whole run or a whole length, so the work and the plan depend on the
    number of distinct lengths, not on the number of pieces.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
    rooms: list[int] = []  # sorted rooms that have runs
    plan, sequences = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if not runs[room]:
                bisect.insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length  # so many fit into one new sequence
                full, rest = divmod(left, each)
                for k in range(each):
                    if full:
                        plan.append((length, rank + k * full, full, sequences, k * length))
                if full:
                    put(capacity - each * length, sequences, full)
                    rank, sequences = rank + each * full, sequences + full
                for k in range(rest):
                    plan.append((length, rank + k, 1, sequences, k * length))
                if rest:
                    put(capacity - rest * length, sequences, 1)
                    sequences += 1
                break
            room = rooms[at]
            first, count = runs[room].pop()
            used = min(count, left)
            if not runs[room]:
                rooms.pop(at)
            plan.append((length, rank, used, first, capacity - room))
            put(room - length, first, used)
            put(room, first + used, count - used)
            rank, left = rank + used, left - used
    return np.array(plan, np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, id_col: str, most: int) -> DataFrame:
    """A gapless 0-based rank among the pieces of each length, of at most ``most`` rows, from parts."""
    parts = max(64, -(-most // PART_ROWS))
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64("_n", "ids_crc32", F.col(id_col)), F.lit(parts)))
    inside = Window.partitionBy("length", "_part").orderBy(id_col, "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("length", "_part")
        .agg(F.count("*").alias("n"))
        .select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    at = keyed.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    return at.withColumn("_rank", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def pack(
    df: DataFrame, tokenizer: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY
) -> DataFrame:
    """Columns id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = save(pieces_of(df, tokenizer, text, id_col, capacity), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    full, rest = counts.pop(capacity, 0), max(counts.values(), default=0)
    plan = plan_best_fit(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    planned = int((plan[:, 2] + plan[:, 3]).max()) if len(plan) else 0
    shared = df.sparkSession.sparkContext.broadcast(plan)  # bounded by the number of lengths

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots = shared.value
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
        at = np.searchsorted((slots[:, 0] << RANK_BITS) + slots[:, 1], (length << RANK_BITS) + rank, "right") - 1
        mine = slots[at]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in names[:5]]
        kept += [pa.array(mine[:, 3] + rank - mine[:, 1]), pa.array(mine[:, 4])]
        return pa.RecordBatch.from_arrays(kept, names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    part = pieces.where(F.col("length") < capacity)
    out = arrow_map(ranked(part, id_col, rest), take, schema)
    if not full:
        return out
    alone = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(planned))
    return out.unionByName(alone.withColumn("offset", F.lit(0).cast("long")).select(names))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
