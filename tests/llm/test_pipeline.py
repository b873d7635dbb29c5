import os

import pytest

import corpus_pipeline as P
from coppice.llm.decontaminate import find_leaks
from coppice.llm.ngram_join import jaccard_components

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = P.save(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.7 * seen[0]
    left = jaccard_components(docs, width=P.SHINGLE_WORDS, percent=P.SIMILAR_PERCENT)
    assert left.where("component_id <> doc_id").isEmpty()
    assert find_leaks(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).isEmpty()
    packed = P.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == seen[-1]


def test_one_of_each_group(spark, docs_of):
    text = " ".join(f"word{i}" for i in range(40))
    docs = docs_of([text, text + " more", "another text of its own kind", None, text])
    once = docs.where("doc_id = 2")
    got = P.one_of_each_group(spark, docs.union(once), "").collect()
    assert sorted(r.doc_id for r in got) == [0, 2, 3]
