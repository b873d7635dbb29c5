import random
import re

import numpy as np
import pytest

from coppice.llm import ngram_join as J
from coppice.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(texts, width, percent):
    sets = [word_sets(t, width) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choices(words, k=rng.randint(1, 60)) for _ in range(12)]
    passage = rng.choices(words, k=30)
    out = [None, "", " \t\n", "One", "one", "ONE two", "É é", "a b c d"]
    for _ in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice([*words, f"x{rng.randrange(10**6)}"])
        if rng.random() < 0.3:
            text += passage
        out.append(" ".join(text))
    out += [" ".join(base[3])] * 30
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
@pytest.mark.parametrize("short", [0, 3, 24])
def test_components_equal_brute_force(spark, docs_of, monkeypatch, width, percent, short):
    monkeypatch.setattr(J, "SHORT_LIST", short)
    texts = corpus(width + short)
    docs = docs_of(texts).withColumnsRenamed({"source": "a", "n_chars": "n"}).repartition(3)
    got = J.jaccard_components(docs, width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(texts, width, percent)


def test_edge_rows(spark, docs_of):
    assert J.jaccard_components(docs_of([])).count() == 0
    twice = docs_of(["same words here for all", None])
    got = J.jaccard_components(twice.union(twice)).collect()
    assert sorted((r.doc_id, r.component_id, r.copies) for r in got) == [(0, 0, 2), (0, 0, 2), (1, 1, 1), (1, 1, 1)]
    long = " ".join(f"word{i % 7919}" for i in range(60_000))
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs_of([long, long + " end", "short"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_shingle_hashes_depend_on_the_text_alone():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "b", "\0", "B", "é", "a\0"], k=rng.randint(0, 9))) for _ in range(300)]
    together, alone = shingle_sets(texts, 4), [shingle_sets([t], 4)[0] for t in texts]
    assert all(np.array_equal(x, y) for x, y in zip(together, alone, strict=True))
    of = {}
    for text, hashes in zip(texts, together, strict=True):
        expected = word_sets(text, 4)
        assert len(hashes) == len(expected)
        assert of.setdefault(expected, hashes.tobytes()) == hashes.tobytes()
    assert len(set(of.values())) == len(of)


@pytest.mark.parametrize("block", [3, 512])
def test_every_link_is_counted(docs_of, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:30], *(rng.choice("xyz") for _ in range(2)), *words[30 + rng.randint(0, 2) :]]) for _ in range(24)]
    texts += [texts[0], texts[0], " ".join(words[::-1]), "short", "short", "", None]
    got = {r.doc_id: r for r in J.jaccard_components(docs_of(texts), links=True).collect()}
    sets = [set(s.tolist()) for s in J.shingle_sets(texts, 4)]
    want = [
        sum(i != j and bool(x) and 100 * len(x & y) >= 85 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)
    ]
    assert [got[i].n_links for i in range(len(texts))] == want
    assert len({got[i].component_id for i in range(26) if want[i]}) == 1 and max(want) > 5
