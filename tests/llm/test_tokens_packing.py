import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coppice.llm import packing as P
from coppice.llm import token_counts as T
from coppice.llm.tokens import BpeEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
tokenizer = Tokenizer.from_file(PATH)
tokenizer.encode_special_tokens = True


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab Z9.,'!\n\t é日ß\U0001f600́ sdmt"), max_size=40))
def test_ids_equal_the_tokenizers(text):
    assert BpeEncoder.of(PATH).encode_bytes(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_awkward_texts():
    for text in ["<|endoftext|> x", "a  b", " ", "\r\n\r\n x", "it's we'll 'S", "١٢٣ ⅷ x²", "éa", "x" * 5000, "a\x00b"]:
        assert BpeEncoder.of(PATH).encode_bytes(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_place_every_piece_once(lengths):
    counts = Counter(lengths)
    plan = P.plan_best_fit(counts, 64)
    ranks, used = {n: set() for n in counts}, {}
    for length, rank, count, first, offset in plan.tolist():
        for k in range(count):
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
            used.setdefault(first + k, []).append((offset, length))
    assert all(ranks[n] == set(range(c)) for n, c in counts.items())
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) >= -(-sum(lengths) // 64)


def test_packing_of_documents(spark, docs_of):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.choice([1, 5, 50, 700, 2047, 2048, 5000]))) for _ in range(60)]
    texts += [None, "", "same"] + ["same"] * 20
    got = P.pack(docs_of(texts).repartition(5), PATH).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert all(r.length == 2048 for r in parts[1:]) and parts[0].length <= 2048
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False))
    assert P.pack(docs_of([]), PATH).count() == 0


def brute_count(unigram, text):
    costs = {p: c for p, c in unigram.ends.items() if c is not None}
    best = [(0, 0)]
    for end in range(1, len(text) + 1):
        found = [(best[s][0] + costs[text[s:end]], best[s][1] + 1) for s in range(end) if text[s:end] in costs]
        if text[end - 1] not in costs:
            n = len(text[end - 1].encode())
            found.append((best[end - 1][0] + n * unigram.byte_cost, best[end - 1][1] + n))
        best.append(min(found))
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé日", min_size=1, max_size=9), max_size=12))
def test_trie_equals_plain_dynamic_programming(words):
    unigram = T.Unigram({"▁": 5, "a": 4, "b": 6, "ab": 7, "abc": 9, "▁a": 6, "ca": 3, "c": 9, "bca": 10}, 11)
    trie = T.Trie(unigram)
    for w in words:
        assert trie.count(w) == brute_count(unigram, "▁" + w)


def test_token_counts(spark, docs_of, monkeypatch):
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", "  ", "the the theme", "日本 x", "longword" * 40, "the theme the"]
    got = {r.doc_id: tuple(r)[1:] for r in T.count_tokens(docs_of(texts), model).collect()}
    unigram = T.Unigram.from_file(model)
    for i, text in enumerate(texts):
        found = [brute_count(unigram, "▁" + w) for w in (text or "").split()]
        assert got[i] == (len(found), sum(n for _, n in found), sum(c for c, _ in found), len((text or "").encode()))
    assert got[3][1:3] == got[6][1:3]
    assert T.count_tokens(docs_of([]), model).count() == 0
    small = T.Trie(unigram)
    monkeypatch.setattr(T, "MOST_NODES", 5)
    monkeypatch.setattr(T, "MOST_WORDS", 2)
    assert [small.count(w) for w in ("theme", "then", "theme", "other")] == [brute_count(unigram, "▁" + w) for w in ("theme", "then", "theme", "other")]


def test_capacity_must_hold(spark, docs_of):
    got = P.pack(docs_of(["a b c d e f g"]), PATH, capacity=3).collect()
    assert sorted((r.piece, r.start, r.length) for r in got) == [(0, 0, 2), (1, 2, 3), (2, 5, 3)]


if __name__ == "__main__":
    pytest.main([__file__])
