"""Alignment against a plain version: whole texts by the libraries, groups by walking byte offsets, counts by dictionaries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coppice.llm import alignment as A
from coppice.llm.tokens import byte_of_char

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
first = Tokenizer.from_file(BPE)
first.encode_special_tokens = True
second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
BYTE = byte_of_char()


def spelled(text):
    """(ids, bytes of each) of both sides."""
    x = first.encode(" " + text, add_special_tokens=False)
    y = second.encode(text)
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    return (x.ids, [bytes(BYTE[c] for c in first.id_to_token(i)) for i in x.ids]), (y, [piece(second.id_to_piece(i)) for i in y])


def brute_groups(text):
    if not text:
        return []
    (x, p), (y, q) = spelled(text)
    if not b"".join(p) == b"".join(q) == (" " + text).encode():
        return []
    groups, i, j, left, right, a, b = [], 0, 0, 0, 0, [], []
    while i < len(x) or j < len(y):
        if left <= right and i < len(x):
            left, i = left + len(p[i]), i + 1
            a.append(x[i - 1])
        else:
            right, j = right + len(q[j]), j + 1
            b.append(y[j - 1])
        if left == right:
            groups.append((a, b))
            a, b = [], []
    assert not a and not b
    return groups


def brute(texts):
    found = [brute_groups(t) for t in texts]
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in found]
    counts = Counter(pair for c in links for pair in c)
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for groups, c in zip(found, links, strict=True):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        n_best = sum(k for p, k in c.items() if counts[p] == best[p[0]])
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()), n_best, sum(k * counts[p] for p, k in c.items()), sha))
    return rows, counts


RNG = random.Random(5)
LETTERS = "abcde AZ09.,'!\n\t é日本ß\U0001f600́ 　ก"
TEXTS = [
    None, "", " ", "  ", "a", "the same text", "the same text", "x" * 3000, "▁ block", "a▁b", "<s> </s> <unk> <0x0A> <|endoftext|>", "  two  spaces   and more ",
    "it's we'll\r\n\r\n\tx\x00y", "日本語のテキスト" * 20, "é é ﬁ ①", "word " * 9000, " " * 40_000, "ab" * 20_000 + " tail", "   wide",
    *["".join(RNG.choices(LETTERS, k=RNG.choice([3, 30, 300]))) for _ in range(60)],
]


@pytest.mark.parametrize("frequent", [A.FREQUENT_PAIRS, 20, 0])
def test_alignment_equals_a_plain_version(spark, docs_of, monkeypatch, frequent):
    monkeypatch.setattr(A, "FREQUENT_PAIRS", frequent)
    expected, counts = brute(TEXTS)
    documents, pairs = A.align(docs_of(TEXTS).repartition(3), BPE, PIECES)
    assert documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r[0]: tuple(r)[1:] for r in documents.collect()} == dict(enumerate(expected))
    rows = pairs.collect()
    assert {(r.a, r.b): r.n for r in rows} == counts
    assert all(r.best_a == max(n for (a, _), n in counts.items() if a == r.a) for r in rows[:50])
    assert all(r.best_b == max(n for (_, b), n in counts.items() if b == r.b) for r in rows[:50])


def test_tasks_that_send_their_pairs_in_parts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(A, "HELD_PAIRS", 50)
    monkeypatch.setattr(A, "WIDE_GROUP", 2)
    monkeypatch.setattr(A, "PART_BYTES", 100)
    monkeypatch.setattr(A, "CUT_CHARS", 7)
    found = A.Encoders(BPE, PIECES)
    monkeypatch.setattr(A.Encoders, "of", classmethod(lambda *_: found))
    texts = TEXTS[:15] + TEXTS[18:]
    got = [found.both(t) for t in texts]
    assert [len(a) for a, _ in got] == [r[0] for r in brute(texts)[0]]
    batch = A.Aligned(found, texts)
    expected, _ = brute(texts)
    assert batch.digests(found.written) == [r[-1] for r in expected]
    document, pairs, times = batch.links()
    for i, t in enumerate(texts):
        plain = Counter((a, b) for x, y in brute_groups(t) for a in x for b in y)
        mine = document == i
        assert {(p >> A.ID_BITS, p & ((1 << A.ID_BITS) - 1)): k for p, k in zip(pairs[mine].tolist(), times[mine].tolist(), strict=True)} == plain


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=30), st.lists(st.integers(1, 5), max_size=30))
def test_common_ends(x, y):
    x, y = np.cumsum(x, dtype=np.int64), np.cumsum(y, dtype=np.int64)
    both = sorted(set(x.tolist()) & set(y.tolist()))
    a, b = A.common_ends(x, y)
    assert a.tolist() == [x.tolist().index(e) + 1 for e in both] and b.tolist() == [y.tolist().index(e) + 1 for e in both]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, (1 << 40) - 1), st.integers(1, 1 << 60)))
def test_packed_links_come_back(links):
    pairs = np.array(sorted(links), np.int64)
    times = np.array([links[p] for p in pairs.tolist()], np.int64)
    a, b = A.unpacked_links(A.packed_links(pairs, times))
    assert a.tolist() == pairs.tolist() and b.tolist() == times.tolist()


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_awkward_tables(spark, kind):
    big = (1 << 60) + 1  # not a double
    df = spark.createDataFrame([(big, "one text", 1), (big, "one text", 2), (None, "one text", 3), (None, None, 4)], "doc_id long, text string, n_a long")
    df = df.withColumn("doc_id", df.doc_id.cast(kind))
    rows = A.align(df, BPE, PIECES)[0].collect()
    assert sorted((str(r.doc_id), r.n_a, r.count_sum) for r in rows) == sorted([(str(big), 2, 6), (str(big), 2, 6), ("None", 2, 6), ("None", 0, 0)])
    documents, pairs = A.align(df.limit(0), BPE, PIECES)
    assert documents.count() == 0 and pairs.count() == 0
