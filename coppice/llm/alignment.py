"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

1. ``mapInPandas`` encodes each text twice and walks both lists of cumulative token
   ends with two pointers, a whole batch in one linear merge of two sorted runs.  Where
   both have an end the tokens since the last common end are a group; each of its first
   tokens is linked with each of its second ones.  A row a document is written: its
   numbers, the digest of its groups and its distinct linked id pairs.
2. Spark counts in how many documents each id pair is linked: tasks send each pair once
   with the documents they have seen, ``groupBy`` adds them up, and the maxima of either
   side are joined to the pairs.
3. The counts go back to the documents.  The most frequent pairs, a fixed number of
   them, are broadcast and looked up where the documents are, so that no pair that many
   documents hold is moved; the others, rare by then, are joined and summed a document.
   Every pair gets its exact count one way or the other.

Null and empty texts, and those whose tokens don't spell a space and the text (a text
that holds U+2581), have no tokens: zeros and an empty digest, and they count nowhere.
Repeated rows are documents of their own, with or without an id; an empty table gives
an empty result; further columns are ignored.  A text is cut before spaces for the
second encoder, which bounds its memory and changes nothing, as no piece has a space
after another character (where a vocabulary has such a piece, texts stay whole).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import give_back, table
from coppice.llm.tokens import BpeEncoder, vocabulary
from coppice.session import save, ship, spread

ID_BITS = 20
SPACE = "▁"
CUT_CHARS = 16384
WIDE_GROUP = 256  # links; wider groups are counted by distinct ids
PART_BYTES = 1 << 20
HELD_PAIRS = 1 << 20  # that a task adds up before it sends them
FREQUENT_PAIRS = 1 << 19
DOCUMENT = "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class Encoders:
    """Both vocabularies of a process: ids of texts and the bytes of ids."""

    _made: ClassVar[dict[tuple[str, str], Encoders]] = {}

    def __init__(self, bpe: str, pieces: str) -> None:
        self.first = BpeEncoder.of(bpe)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        spelled = vocabulary(bpe)
        n, m = max(spelled.values()) + 1, self.second.get_piece_size()
        if max(n, m) > 1 << ID_BITS:
            raise ValueError(f"a vocabulary of more than {1 << ID_BITS} ids")
        self.bytes_of_first = [b""] * n
        for x, i in spelled.items():
            self.bytes_of_first[i] = x
        names = [self.second.id_to_piece(i) for i in range(m)]
        self.bytes_of_second = [bytes([int(x[1:-1], 16)]) if self.second.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.bytes_of_first, self.bytes_of_second)]
        self.cut = None if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in names) else re.compile(rf"(?s).{{1,{CUT_CHARS}}} *[^ ]*(?: +\Z)?")
        #: decimal ids with what may follow them, at 3 * id + which
        self.written = [b"%d%c" % (i, c) for i in range(max(n, m)) for c in b",|;"]

    @classmethod
    def of(cls, bpe: str, pieces: str) -> Encoders:
        if (bpe, pieces) not in cls._made:
            cls._made[bpe, pieces] = cls(bpe, pieces)
        return cls._made[bpe, pieces]

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and the text by either vocabulary; none where they don't spell it."""
        if text:
            whole = " " + text
            parts = self.cut.findall(whole) if self.cut else [whole]
            a = np.frombuffer(self.first.encode_bytes(whole), "<u4").astype(np.int64)
            b = [i for ids in self.second.encode([x[1:] for x in parts], num_threads=1) for i in ids]
            sides = (a.tolist(), self.bytes_of_first), (b, self.bytes_of_second)
            if all(b"".join(map(spelled.__getitem__, ids)) == whole.encode() for ids, spelled in sides):
                return a, np.array(b, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def common_ends(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where both pointers stand, how many tokens of each are passed, at every end that both sides have.

    Ends ascend; the stable sort of two sorted runs is their linear merge.
    """
    merged = np.sort(np.concatenate([first << 1, (second << 1) | 1]), kind="stable")
    passed = np.cumsum(merged & 1)
    at = np.flatnonzero(merged[1:] >> 1 == merged[:-1] >> 1) + 1
    return at + 1 - passed[at], passed[at]


class Aligned:
    """Groups of a batch: ids of both sides, and for each group how many of either it has, and its document."""

    def __init__(self, encoders: Encoders, texts: list[str | None]) -> None:
        found = [encoders.both(t) for t in texts]
        self.ids = [np.concatenate([x[side] for x in found] or [np.zeros(0, np.int64)]) for side in (0, 1)]
        self.tokens = [np.array([len(x[side]) for x in found], np.int64) for side in (0, 1)]
        ends = [np.cumsum(lengths[ids]) for lengths, ids in zip(encoders.lengths, self.ids, strict=True)]
        self.stops = common_ends(*ends)
        self.sizes = [np.diff(x, prepend=0) for x in self.stops]
        self.starts = [x - n for x, n in zip(self.stops, self.sizes, strict=True)]
        # a document's last end is common, too
        last = np.searchsorted(self.stops[0], np.cumsum(self.tokens[0]), "right")
        self.groups = np.diff(last, prepend=0)
        self.document = np.repeat(np.arange(len(texts)), self.groups)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        upto = np.cumsum(self.groups)
        return sums[upto] - sums[upto - self.groups]

    def digests(self, written: list[bytes]) -> list[str]:
        """Each document's groups in order, first ids, then second ones, as text and hashed."""
        (n, m), total = self.sizes, len(self.ids[0]) + len(self.ids[1])
        codes = np.zeros(total, np.int64)
        codes[np.arange(len(self.ids[0])) + np.repeat(self.starts[1], n)] = 3 * self.ids[0]
        codes[np.arange(len(self.ids[1])) + np.repeat(self.stops[0], m)] = 3 * self.ids[1]
        codes[self.stops[0] + self.starts[1] - 1] += 1
        codes[self.stops[0] + self.stops[1] - 1] += 2
        spelled, at, out = codes.tolist(), 0, []
        for n in (self.tokens[0] + self.tokens[1]).tolist():
            out.append(hashlib.sha256(b"".join(map(written.__getitem__, spelled[at : at + n]))[:-1]).hexdigest() if n else "")
            at += n
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, distinct linked id pairs in ascending order, and how often each is linked."""
        n, m = self.sizes
        many = n * m
        narrow = np.flatnonzero(many <= WIDE_GROUP)
        k = many[narrow]
        g = np.repeat(narrow, k)
        step = np.arange(len(g)) - np.repeat(np.cumsum(k) - k, k)
        a, b = self.ids[0][self.starts[0][g] + step // m[g]], self.ids[1][self.starts[1][g] + step % m[g]]
        found, times = [pair_codes(self.document[g], a, b)], [np.ones(len(g), np.int64)]
        for w in np.flatnonzero(many > WIDE_GROUP):
            (a, x), (b, y) = (np.unique(ids[s : s + z], return_counts=True) for ids, s, z in zip(self.ids, (v[w] for v in self.starts), (v[w] for v in self.sizes), strict=True))
            found.append(pair_codes(self.document[w], np.repeat(a, len(b)), np.tile(b, len(a))))
            times.append(np.outer(x, y).ravel())
        codes, times = summed(np.concatenate(found), np.concatenate(times))
        return codes >> 2 * ID_BITS, codes & ((1 << 2 * ID_BITS) - 1), times


def pair_codes(document: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (document << 2 * ID_BITS) | (a << ID_BITS) | b


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(values[order], first)


def packed_links(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending pairs and their numbers as one small value; ``unpacked_links`` gives them back."""
    if not len(pairs):
        return b""
    columns = np.stack([np.diff(pairs, prepend=0), times]).astype("<i8")
    return zstandard.compress(columns.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes())


def unpacked_links(value: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not value:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(2, 8, -1)
    steps, times = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8")[..., 0]
    return np.cumsum(steps), times


def parts_of(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Bounds of runs of about ``PART_BYTES``; a single text is never cut here."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= PART_BYTES:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def aligned_documents(df: DataFrame, bpe: str, pieces: str, text: str, id_col: str) -> DataFrame:
    """One row a document: its numbers, the digest of its groups and its packed links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders = Encoders.of(bpe, pieces)
        for batch in batches:
            for lower, upper in parts_of(batch["text"]):
                found = Aligned(encoders, batch["text"].iloc[lower:upper].tolist())
                document, pairs, times = found.links()
                cuts = np.searchsorted(document, np.arange(upper - lower + 1))
                columns = {
                    "id": batch["id"].iloc[lower:upper].to_numpy(),
                    "n_a": found.tokens[0],
                    "n_b": found.tokens[1],
                    "n_groups": found.groups,
                    "n_links": found.per_document(found.sizes[0] * found.sizes[1]),
                    "groups_sha256": found.digests(encoders.written),
                    "links": [packed_links(pairs[a:b], times[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)],
                }
                yield pd.DataFrame(columns)
        give_back()

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(run, f"{DOCUMENT}, links binary")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n): in how many documents each id pair is linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting = [], 0
        for batch in batches:
            for value in batch["links"]:
                pairs, _ = unpacked_links(value)
                held.append((pairs, np.ones(len(pairs), np.int64)))
                waiting += len(pairs)
                if waiting > HELD_PAIRS:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    waiting = len(held[0][0])
                    if waiting > HELD_PAIRS // 2:
                        yield pd.DataFrame({"pair": held[0][0], "n": held[0][1]})
                        held, waiting = [], 0
        if held:
            pairs, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            yield pd.DataFrame({"pair": pairs, "n": n})

    return aligned.select("links").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_maxima(counts: DataFrame) -> DataFrame:
    """Rows (pair, a, b, n, best_a, best_b): the highest counts of either id beside each pair's own."""
    named = counts.select("pair", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b"), "n")
    for side in ("a", "b"):
        named = named.join(counts_of_side(named, side), side)
    return named.select("pair", "a", "b", "n", "best_a", "best_b")


def counts_of_side(named: DataFrame, side: str) -> DataFrame:
    return named.groupBy(side).agg(F.max("n").alias(f"best_{side}"))


def document_sums(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents with ``n_best`` and ``count_sum`` over their links."""
    scored = pairs.select("pair", "n", (F.col("n") == F.col("best_a")).alias("best"))
    top = scored.orderBy(F.desc("n"), "pair").limit(FREQUENT_PAIRS).toArrow().sort_by("pair")  # a fixed number
    shared = pairs.sparkSession.sparkContext.broadcast([top[c].to_numpy() for c in ("pair", "n", "best")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, best = shared.value
        for batch in batches:
            sums, rest = [], []
            for value in batch.pop("links"):
                found, times = unpacked_links(value)
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                here = known[at] == found if len(known) else np.zeros(len(found), bool)
                at, counted = at[here], times[here]
                sums.append((int(counted[best[at]].sum()), int((counted * n[at]).sum())))
                rest.append([{"pair": p, "times": k} for p, k in zip(found[~here].tolist(), times[~here].tolist(), strict=True)])
            batch["n_best"], batch["count_sum"] = np.array(sums, np.int64).reshape(-1, 2).T
            batch["rest"] = rest
            yield batch

    numbered = aligned.withColumn("row", F.monotonically_increasing_id())
    schema = f"{DOCUMENT}, row long, n_best long, count_sum long, rest array<struct<pair:long,times:long>>"
    order = [f.split()[0] for f in DOCUMENT.split(", ")]
    documents = save(numbered.select(*order, "links", "row").mapInPandas(run, schema), "aligned-sums")
    rare = (
        documents.where(F.size("rest") > 0)
        .select("row", F.explode("rest").alias("r"))
        .select("row", "r.*")
        .join(scored, "pair")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    )
    rare = save(rare, "aligned-rare")
    total = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).alias(own)
    return documents.join(rare, "row", "left").select(*order, total("n_best", "_best"), total("count_sum", "_sum"))


def align(df: DataFrame, bpe: str, pieces: str, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the id pairs (a, b, n, best_a, best_b)."""
    ship(df.sparkSession)
    aligned = save(aligned_documents(df, bpe, pieces, text, id_col), "aligned")
    pairs = save(with_maxima(save(pair_counts(aligned), "pair-counts")), "pairs")
    found = document_sums(aligned, pairs)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return found.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), *names), pairs.drop("pair")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(table(spark, sf_dir, "documents"))
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
