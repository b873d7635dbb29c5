"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and all but the last return the columns of ``documents``.  Decisions are tables
of ids to drop, written to the shared folder first: the planner then knows their
size and broadcasts them only where it is small, so the texts mostly stay put.

Rows whose doc_id is null can't be named in such a table; they are kept by the
filtering stages.  Rows that repeat a doc_id share its decision, and one of them
stays after the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import table
from coppice.llm.decontaminate import find_leaks
from coppice.llm.langid import identify
from coppice.llm.ngram_join import jaccard_components
from coppice.llm.packing import pack
from coppice.llm.quality import score_quality
from coppice.session import save, ship

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(save(ids.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no letters, or unlike every learned language."""
    return without(docs, identify(docs).where("rejected"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier doesn't accept."""
    return without(docs, score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one of smallest id stays."""
    found = jaccard_components(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    kept = without(docs, found.where("component_id <> doc_id"))
    repeated = save(kept.groupBy("doc_id").count().where("count > 1 and doc_id is not null"), "repeated")
    if repeated.isEmpty():
        return kept
    single = kept.join(repeated.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated.select("doc_id"), "doc_id", "left_anti").select(docs.columns).unionByName(single.select(docs.columns))


def no_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the packing plan over what is left."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", no_benchmark_leaks),
    ("packing", packed),
]

#: None: models and searches to convergence aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
