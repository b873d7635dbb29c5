import random

from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm import decontaminate as D


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=120))
def test_myers_equals_dynamic_programming(pattern, text):
    got = D.myers_search(D.myers_masks(pattern), len(pattern), text, len(pattern))
    assert (got[0] if got else len(pattern)) == distance(pattern, text)


def test_leaks_equal_brute_force(spark, docs_of):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "kmst" for b in ("ala", "ero", "ini", "olu")]
    items = [" ".join(rng.choices(words, k=k)) for k in (1, 3, 8, 20, 40, 40)] + [None, "", "  "]
    texts = [None, "", " ".join(rng.choices(words, k=300)), items[0], "x" + items[1] + "x"]
    for item in items[1:6]:
        for edits in (0, 1, 2, 4, 8, 16):
            chars = list(item)
            for _ in range(edits):
                chars[rng.randrange(len(chars))] = rng.choice(["", "q", "qq"])
            texts.append("Start of it. " + "".join(chars).upper().replace(" ", "\n ") + " and the end")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in D.find_leaks(docs_of(texts), benchmark).collect()}
    expected = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            p, t = D.normalise(item), D.normalise(text)
            if not p or not t:
                continue
            k = distance(p, t)
            if len(p) < D.EXACT_BELOW:
                found = [a for a in range(len(t)) if t.startswith(p, a) and D.standing(t, a, a + len(p))]
                if found:
                    expected[d, i] = 0
            elif k <= D.budget(len(p)):
                expected[d, i] = k
    assert got == expected


def test_blocks_and_empty_tables(spark, docs_of, monkeypatch):
    items = [(i, f"some item number {i} of the benchmark") for i in range(7)] + [(3, "some item number 3 of the benchmark")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([f"well, {t}." for _, t in items[:7]])
    whole = sorted(map(tuple, D.find_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 80)
    assert sorted(map(tuple, D.find_leaks(docs, benchmark).collect())) == whole
    assert {r[:2] for r in whole} >= {(i, i) for i in range(7)}
    assert D.find_leaks(docs, benchmark.limit(0)).count() == 0
    assert D.find_leaks(docs.limit(0), benchmark).count() == 0
