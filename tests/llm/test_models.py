import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coppice.llm import langid as L
from coppice.llm import quality as Q

SYLLABLES = {"aa": "ka mo ri tu lem", "bb": "sch ung ber tz ein", "cc": "eau que ç é oi"}


def sentences(lang, rng, n=40):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def test_kneser_ney_equals_its_definition():
    rng = random.Random(1)
    texts = {lang: [sentences(lang, rng, 12) for _ in range(4)] for lang in ("aa", "bb")}
    rows = {}
    for lang, group in texts.items():
        for t in group:
            codes, starts = L.symbols([t])
            s = [chr(c) for c in codes]
            for e in np.flatnonzero(L.predicted(codes, starts)):
                g = "".join(s[e - 3 : e + 1])
                rows[lang, g] = rows.get((lang, g), 0) + 1
    model = L.kneser_ney(pd.DataFrame([(a, g, n) for (a, g), n in rows.items()], columns=["lang", "gram", "n"]))

    def counts(lang, order):
        if order == 4:
            return {g: n for (a, g), n in rows.items() if a == lang}
        out = {}
        for g in counts(lang, order + 1):
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    alphabet = len({g[-1] for _, g in rows})

    def p(lang, gram):
        if not gram:
            return 1 / (alphabet + 1)
        c = counts(lang, len(gram))
        once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
        d = min(max(once / max(once + 2 * twice, 1) if once else 0.5, 0.1), 0.9)
        same = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(lang, gram[1:])
        total = sum(same.values())
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * p(lang, gram[1:])

    probe = "Kamo schq lemeau ber"
    codes, starts = L.symbols([probe])
    got = model.log_probabilities(codes)
    s = [chr(c) for c in codes]
    for e in np.flatnonzero(L.predicted(codes, starts)):
        for k, lang in enumerate(model.languages):
            assert got[e, k] == pytest.approx(np.log(p(lang, "".join(s[e - 3 : e + 1]))), abs=1e-4)


def test_languages_of_held_out_documents(spark, docs_of):
    rng = random.Random(3)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(300)]
    texts = [sentences(x, rng) for x in langs]
    texts += [None, "", "1234 !!", "ка", "x"]
    docs = docs_of(texts, [*langs, None, None, "aa", None, None])
    got = {r.doc_id: r for r in L.identify(docs.withColumn("score", F.lit(1))).collect()}
    assert len(got) == 305
    held = [i for i in range(300) if got[i].held_out]
    assert 40 < len(held) < 110
    assert sum(got[i].lang_pred == langs[i] for i in held) >= 0.98 * len(held)
    assert not any(got[i].rejected for i in range(300))
    for i in (300, 301, 302):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[303].lang_pred in SYLLABLES and got[303].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_a_model_in_shards_leaves_no_gram_out(spark, docs_of, monkeypatch):
    rng = random.Random(7)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(120)]
    texts = [sentences(x, rng, 20) for x in langs]
    rare = "".join(chr(0x4E00 + 7 * i) for i in range(60))  # a language whose n-grams occur once
    docs = docs_of([*texts, rare, rare, rare, rare, "", None], [*langs, *["zz"] * 4, None, "aa"]).where("doc_id not in (121, 122)")
    whole = {r.doc_id: r for r in L.identify(docs).collect()}
    monkeypatch.setattr(L, "MOST_CELLS", 500)
    languages, shards = L.train(docs, "text", "lang", "doc_id")
    assert len(shards) > 3 and "zz" in languages
    assert all(a.high == b.low for a, b in zip(shards, shards[1:], strict=False)) and shards[0].low == 0
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert got.keys() == whole.keys()
    for i, r in got.items():
        assert (r.lang_pred, r.rejected, r.held_out) == (whole[i].lang_pred, whole[i].rejected, whole[i].held_out)
        assert r.score == pytest.approx(whole[i].score, abs=1e-6)
        assert r.cross_entropy == (None if whole[i].cross_entropy is None else pytest.approx(whole[i].cross_entropy, abs=1e-5))
    assert got[120].lang_pred == "zz" or got[123].lang_pred == "zz"


def test_language_without_training(spark, docs_of):
    assert {r.lang_pred for r in L.identify(docs_of(["some text"])).collect()} == {"und"}
    assert L.identify(docs_of([])).count() == 0


def test_held_out_rows_never_teach(spark, docs_of):
    rng = random.Random(4)
    langs = [rng.choice(["aa", "bb"]) for _ in range(120)]
    docs = docs_of([sentences(x, rng) for x in langs], langs)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.identify(d).collect()} for d in (docs, wrong))
    assert a == b


def test_quality_of_held_out_documents(spark, docs_of):
    rng = random.Random(5)
    good = [rng.random() < 0.7 for _ in range(400)]
    texts = [sentences("aa", rng) if g else sentences("aa", rng).replace(" ", " | ") for g in good]
    docs = docs_of([*texts, None, "", "word"])
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)] + [(1, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.score_quality(docs, labels).collect()}
    assert len(got) == 403
    held = [i for i in range(400) if got[i].held_out]
    assert sum((got[i].predicted == 1) == good[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    none = Q.score_quality(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert Q.score_quality(docs.limit(0), labels).count() == 0


def test_context_sums_add_up_over_partitions(spark, docs_of):
    rng = random.Random(6)
    docs = docs_of([sentences("bb", rng) for _ in range(40)])
    one, many = Q.context_sums(docs.coalesce(1), "text"), Q.context_sums(docs.repartition(7), "text")
    assert all(np.array_equal(a, b) for a, b in zip(one, many, strict=True))
    assert one[1][: Q.WORDS].sum() == one[1][Q.WORDS :].sum() == 40 * 40
