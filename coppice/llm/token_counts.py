"""Token counts under a unigram segmentation, by dynamic programming on a trie.

A pre-token is a word with its leading space mark.  Each worker inserts the
distinct pre-tokens of its rows into a trie whose nodes keep the forward score of
their prefix: the lowest cost of any segmentation of it, and the fewest pieces at
that cost.  A new word computes only the nodes that no earlier word shares, and
its last node is the answer for the word from then on.  No row leaves its
partition: counts are a map over documents, at any input size.

Costs are whole milli-nats, so sums are exact and equal on any machine: the
pieces of the vocabulary file in file order get ``1000 ln(rank + 3)`` (Zipf's
law; nothing is trained), and characters outside it one byte piece for each of
their UTF-8 bytes.  ``tokens`` of a document is the sum over its words.

Null texts count as empty: zeros.  Words of any length are scored whole; words
longer than ``LONG_WORD`` are worked out without being kept.
"""

from __future__ import annotations

import math
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from coppice.llm.common import arrow_map, table
from coppice.session import spread

SPACE = "▁"
LONG_WORD = 64
MOST_NODES = 1_000_000
MOST_WORDS = 500_000


class Unigram:
    """Piece costs; every suffix of a piece is a key too, so that a search backwards knows when to stop."""

    def __init__(self, costs: dict[str, int], byte_cost: int) -> None:
        self.byte_cost = byte_cost
        self.ends: dict[str, int | None] = {}
        for piece in costs:
            for k in range(len(piece)):
                self.ends.setdefault(piece[k:], None)
        self.ends |= costs

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        costs, last = {}, 0
        for i in range(model.get_piece_size()):
            last = round(1000 * math.log(i + 3))
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                costs[model.id_to_piece(i)] = last
        return cls(costs, last + 1000)


class Trie:
    """Prefixes of words with the forward score of each."""

    _made: ClassVar[dict[str, Trie]] = {}

    def __init__(self, unigram: Unigram) -> None:
        self.unigram = unigram
        self.words: dict[str, tuple[int, int]] = {}
        self.clear()

    @classmethod
    def of(cls, path: str) -> Trie:
        """One trie a process, for every task of that worker."""
        if path not in cls._made:
            cls._made[path] = cls(Unigram.from_file(path))
        return cls._made[path]

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.score: list[tuple[int, int]] = [(0, 0)]  # (cost, pieces) of each node; the root is the empty prefix

    def count(self, word: str) -> tuple[int, int]:
        """Cost and number of pieces of one pre-token, from its terminal node."""
        found = self.words.get(word)
        if found is None:
            keep = len(word) <= LONG_WORD
            if keep and len(self.score) > MOST_NODES:
                self.clear()
            found = self.insert(SPACE + word) if keep else self.forward(SPACE + word)
            if keep:
                if len(self.words) >= MOST_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def insert(self, text: str) -> tuple[int, int]:
        node, path, scores = 0, [(0, 0)], self.score
        for i, char in enumerate(text, 1):
            step = (node, char)
            node = self.next.get(step, 0)
            if not node:
                scores.append(self.best(text, i, path))
                node = self.next[step] = len(scores) - 1
            path.append(scores[node])
        return path[-1]

    def forward(self, text: str) -> tuple[int, int]:
        path = [(0, 0)]
        for i in range(1, len(text) + 1):
            path.append(self.best(text, i, path))
        return path[-1]

    def best(self, text: str, end: int, path: list[tuple[int, int]]) -> tuple[int, int]:
        """The forward score of ``text[:end]`` from the scores of its shorter prefixes."""
        ends, best = self.unigram.ends, None
        start = end - 1
        while start >= 0:
            piece = text[start:end]
            if piece not in ends:
                break
            cost = ends[piece]
            if cost is not None:
                before = path[start]
                here = (before[0] + cost, before[1] + 1)
                if best is None or here < best:
                    best = here
            start -= 1
        if text[end - 1 : end] in ends and ends[text[end - 1]] is not None:
            return best
        n = len(text[end - 1].encode("utf-8", "replace"))
        spelled = (path[end - 1][0] + n * self.unigram.byte_cost, path[end - 1][1] + n)
        return spelled if best is None or spelled < best else best


def count_tokens(df: DataFrame, model: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Columns id, words, tokens, cost and n_bytes; one row a row of ``df``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie = Trie.of(model)
        out = np.zeros((batch.num_rows, 4), np.int64)
        for i, value in enumerate(batch.column(1).to_pylist()):
            words = (value or "").split()
            found = [trie.count(w) for w in words]
            cost, pieces = map(sum, zip(*found, strict=True)) if found else (0, 0)
            out[i] = len(words), pieces, cost, len((value or "").encode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.T.copy())], names)

    names = [id_col, "words", "tokens", "cost", "n_bytes"]
    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text), count, f"`{id_col}` {kind}, words long, tokens long, cost long, n_bytes long")


def op4_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))
