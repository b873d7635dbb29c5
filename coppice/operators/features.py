"""Terms of records in long form, document frequencies and weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.functions.text import bigrams, char_ngrams, feature_terms, normalize_text, tokens
from coppice.operators.records import ROW
from coppice.session import in_order, save, save_bucketed, ship

LEAST_DF = 2
MOST_DF = 2000
SLOT_BITS = 25  # the count table has so many bits' worth of slots, whatever the input
CHUNK_SLOTS = 1 << 15


def term_occurrences(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, row_index, term), one for every occurrence."""
    return records.select(*keys, ROW, F.explode(feature_terms(F.col("analysis_text"))).alias("term"))


def terms_of(words: Column, once: Column) -> Column:
    """The terms of a text without repeats, from its words and its distinct words.

    Windows come from each word once.  Words, pairs and windows never equal each other:
    only pairs have a space, only windows a colon.
    """
    return F.concat(once, F.array_distinct(bigrams(words)), F.array_distinct(char_ngrams(once)))


def distinct_terms(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, row_index, term) without repeats; no shuffle, repeats are inside a row."""
    return (
        records.select(*keys, ROW, tokens(normalize_text(F.col("analysis_text"))).alias("_words"))
        .select(*keys, ROW, "_words", F.array_distinct("_words").alias("_once"))
        .select(*keys, ROW, F.explode(terms_of(F.col("_words"), F.col("_once"))).alias("term"))
    )


def term_arrays(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, row_index, terms): the terms of each record without repeats."""

    def once(value: Column, use) -> Column:
        # a variable of a function isn't computed again where it is used, a column of a projection may be
        return F.element_at(F.transform(F.array(value), use), 1)

    words = tokens(normalize_text(F.col("analysis_text")))
    return records.select(*keys, ROW, once(words, lambda w: once(F.array_distinct(w), lambda o: terms_of(w, o))).alias("terms"))


def slot_of(term: Column, keys: tuple[str, ...]) -> Column:
    return F.xxhash64(*keys, term).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def slots_seen_twice(arrays: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (bits): of each slot of the count table, whether two records or more have a term in it.

    Tasks count up to two in a table of fixed size and send the parts of it that aren't empty.
    """
    ship(arrays.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SLOT_BITS, np.uint8)
        for batch in batches:
            slots, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            table[slots] = np.minimum(table[slots] + np.minimum(n, 2), 2)
        for at in range(0, len(table), CHUNK_SLOTS):
            part = table[at : at + CHUNK_SLOTS]
            if part.any():
                bits = np.packbits(np.stack([part == 1, part == 2]), bitorder="little")
                yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK_SLOTS], pa.int32()), pa.array([zstandard.compress(bits.tobytes())])], ["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(2, -1)
                before = found.setdefault(chunk, np.zeros((2, len(once)), np.uint8))
                before[1] |= twice | (before[0] & once)
                before[0] |= once
        for chunk, (_, twice) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([twice.tobytes()])], ["chunk", "bits"])

    schema, spark = "chunk int, bits binary", arrays.sparkSession
    slots = arrays.select(F.transform("terms", lambda t: slot_of(t, keys)).alias("slots"))
    parts = slots.mapInArrow(count, schema).repartition(spark.sparkContext.defaultParallelism, "chunk").mapInArrow(merge, schema)
    whole = np.zeros((max(1, (1 << SLOT_BITS) // CHUNK_SLOTS), min(CHUNK_SLOTS, 1 << SLOT_BITS) // 8), np.uint8)
    for row in parts.collect():  # of a fixed size
        whole[row.chunk] = np.frombuffer(row.bits, np.uint8)
    one = pa.table([pa.array([whole.ravel().view("<i8")], pa.list_(pa.int64()))], ["bits"])
    return spark.createDataFrame(one)


def repeating_terms(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (keys, row_index, term) without repeats and without most terms of a single record.

    A term whose slot only one record has met is of that record alone, so it never
    enters a shuffle; one that shares its slot with others passes and is counted like any.
    """
    arrays = save(term_arrays(records, keys), "term-arrays")
    bits, slot = slots_seen_twice(arrays, keys).scalar(), slot_of(F.col("term"), keys)
    met = F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1
    return arrays.select(*keys, ROW, F.explode("terms").alias("term")).where(met)


def term_frequency(records: DataFrame) -> DataFrame:
    """Rows (row_index, term, tf); texts move once, by row, and their many terms not at all."""
    dealt = records.select(ROW, "analysis_text").repartition(ROW)
    return term_occurrences(dealt).groupBy(ROW, "term").agg(F.count("*").alias("tf"))


def document_frequency(terms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """From distinct terms: rows (keys, term, df)."""
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("df"))


def valid_terms(terms: DataFrame, keys: tuple[str, ...] = (), least: int = LEAST_DF, most: int = MOST_DF) -> DataFrame:
    """Terms rare enough to join on and common enough to join anything."""
    return document_frequency(terms, keys).where(F.col("df").between(least, most))


def tf_idf(records: DataFrame) -> DataFrame:
    """Rows (row_index, term, tf, df, weight): tf * ln(1 + N / df) as 32-bit floats.

    The long table is moved once, into buckets of terms: its count and the join with it stay there.
    """
    tf = save_bucketed(term_frequency(records), "term-frequency", "term", ordered=False)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    total = records.agg(F.greatest(F.count("*"), F.lit(1)).alias("total")).scalar()
    weight = F.col("tf") * F.log1p(total / F.col("df"))
    return tf.join(df, "term").select(ROW, "term", "tf", "df", weight.cast("float").alias("weight"))


def sparse_vectors(records: DataFrame) -> DataFrame:
    """Rows (row_index, terms map) for every record, the map empty where a text has no terms."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "weight")))).alias("terms")
    found = tf_idf(records).groupBy(ROW).agg(entries)
    empty = F.expr("cast(map() as map<string,float>)")
    return records.select(ROW).join(found, ROW, "left").select(ROW, F.coalesce("terms", empty).alias("terms"))


def term_dictionary(records: DataFrame) -> DataFrame:
    """Rows (term, term_id): ids from 0 in order of first appearance (row, then place in the row)."""
    placed = records.select(ROW, F.posexplode(feature_terms(F.col("analysis_text"))).alias("at", "term"))
    first = placed.groupBy("term").agg(F.min(F.struct(ROW, "at")).alias("first"))
    placed, parts = in_order(first.select("term", F.col("first." + ROW).alias(ROW), F.col("first.at").alias("at")), ROW, "at")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = parts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "_part").select("term", (F.col("start") + F.col("_at")).alias("term_id"))


def term_set_sizes(records: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (row_index, n): valid terms of every record, 0 where it has none."""
    sizes = kept.groupBy(ROW).agg(F.count("*").alias("n"))
    return records.select(ROW).join(sizes, ROW, "left").select(ROW, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sizes_of_sets(records: DataFrame, sets: DataFrame) -> DataFrame:
    """The same rows from packed sets (row_index, ids, n)."""
    joined = records.select(ROW).join(sets.select(ROW, "n"), ROW, "left")
    return joined.select(ROW, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
