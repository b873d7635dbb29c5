"""Every operator over awkward tables: ids of other types or missing, names that clash, empty, repeated and long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from coppice.llm.chat import build_threads
from coppice.llm.decontaminate import find_leaks
from coppice.llm.html import extract_text
from coppice.llm.langid import identify
from coppice.llm.media import digests, to_media
from coppice.llm.ngram_join import jaccard_components
from coppice.llm.packing import pack
from coppice.llm.quality import score_quality
from coppice.llm.sharding import shard_by_bytes
from coppice.llm.token_counts import count_tokens

CLASHES = ("a", "b", "n", "t", "id", "at", "item", "size", "shard", "slot", "score", "token", "piece", "length", "component", "held_out", "rejected", "_id", "_n", "_text", "label", "features")
TEXTS = [None, "", "one and the same text here", "one and the same text here", "word " * 30_000, "  ", "é日本 x", "short"]
LANGS = [None, "aa", "aa", "aa", "bb", None, "bb", "aa"]


def table(spark, kind, repeats=1):
    ids = [1, None, 2, 3, 4, 5, 6, None]
    rows = [(i, t, x) for i, t, x in zip(ids, TEXTS, LANGS, strict=True)] * repeats
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "lang", *[F.lit(0).alias(c) for c in CLASHES])


def operators(spark):
    labels = lambda df: df.select("doc_id", F.lit(1).alias("quality"))
    return {
        "join": lambda df: jaccard_components(df, links=True),
        "quality": lambda df: score_quality(df, labels(df)),
        "tokens": lambda df: count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")),
        "packing": lambda df: pack(df, public_tokenizers.path("byte_bpe_50k.json")).where("piece = 0"),
        "language": identify,
        "media": lambda df: digests(to_media(df)),
        "shards": shard_by_bytes,
        "html": lambda df: extract_text(df, html="text", url="lang", id_col="doc_id"),
        "chat": lambda df: build_threads(df.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.col("lang").alias("role"), "text", "level" if "level" in df.columns else "a")),
    }


@pytest.mark.parametrize("name", list(operators(None)))
@pytest.mark.parametrize("kind", ["string", "smallint"])
def test_every_row_has_a_result(spark, name, kind):
    run = operators(spark)[name]
    rows = run(table(spark, kind, 2)).collect()
    assert len(rows) == 16
    key = "conv_id" if name == "chat" else "doc_id"
    assert sum(r[key] is None for r in rows) == 4
    assert sorted({str(r[key]) for r in rows}) == sorted(map(str, {None, 1, 2, 3, 4, 5, 6}))
    assert run(table(spark, kind).limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["string", "smallint"])
def test_leaks_of_awkward_tables(spark, kind):
    docs = table(spark, kind, 2)
    items = spark.createDataFrame([(1, "the same text"), (None, "THE same  text here"), (2, None), (3, ""), (1, "the same text")], "doc_id smallint, text string")
    found = find_leaks(docs, items, item_col="doc_id")
    assert found.columns == ["doc_id", "item", "distance", "allowed", "end"]
    assert sorted((str(r[0]), str(r[1])) for r in found.collect()) == sorted((d, i) for d in ("2", "3") for i in ("1", "1", "None") * 2)
    assert all(find_leaks(x, y, item_col="doc_id").count() == 0 for x, y in ((docs, items.limit(0)), (docs.limit(0), items)))
    near = spark.createDataFrame([(1, "the sqme text")], "item_id long, text string")
    assert find_leaks(docs, near, edit_share=0.1).count() == 0
    assert find_leaks(docs, near, edit_share=0.1, exact_below=0).count() == 4


def test_full_pieces_take_a_sequence_each(spark):
    docs = spark.createDataFrame([(i % 7, "word " * 20) for i in range(40)], "doc_id long, text string")
    got = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=8).collect()
    full = [r for r in got if r.length == 8]
    assert full and all(r.offset == 0 for r in full) and len({r.sequence_id for r in full}) == len(full)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 8 for p in places.values()) and all(min(p)[0] == 0 for p in places.values())
