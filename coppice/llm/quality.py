"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

1. Word vectors, from the whole corpus.  Every token has a fixed sparse +-1 index
   vector (derived from its number); a token's context vector is the sum of the
   index vectors of the tokens beside it over all documents.  Tasks add into one
   matrix of ``TOKENS x WIDTH`` each and send the rows of the tokens they met; a
   two-step aggregate adds them, so the traffic has a bound a task and the broadcast
   model (9 MB) a fixed size at any vocabulary.
2. Documents are the mean of their tokens' centred unit vectors, separately over
   word tokens (lower-case cores, hashed to ``WORDS`` places, many more than there are
   frequent words: rare ones may share a place) and shape tokens (hashed outlines such
   as ``Aa.``, ``A!!`` or ``|``, and one for a word that repeats the one before).
3. A numpy network with one hidden layer, fitted on at most ``MOST_LABELLED``
   labelled documents outside the held-out quarter (the rows of lowest id hash;
   the bound holds for fitting only), with a temperature fitted on a fifth of
   them that the weights haven't seen.

Null and empty texts get a score too (the pooled vector is zero).  Labels that
are null are left out, several labels of one id are averaged.  With no labels, or
labels of one kind only, every score is their mean (0.5 without any).  Repeated
rows count as often as they occur, rows without an id are scored and teach no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, give_back, held_out, mix64, slices, table
from coppice.session import save, ship, spread

WORDS, SHAPES, WIDTH, NONZERO = 1 << 16, 1 << 11, 32, 4
TOKENS = WORDS + SHAPES
REPEATED = TOKENS - 1
CHUNKS = 32
FAN_IN = 16
HIDDEN = 16
MOST_LABELLED = 20_000
ACCEPT = 0.7
MOST_CACHED = 150_000

LETTERS, CAPITALS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")
CORE = re.compile(r"^\W+|\W+$")


class Vocabulary(dict):
    """Word to its word token and shape token in one number, filled as words appear; emptied when full."""

    def __missing__(self, word: str) -> int:
        core = CORE.sub("", word).lower()
        small = LETTERS.sub("a", DIGITS.sub("9", word))
        head = LETTERS.search(word)
        kind = "-" if head is None else "A" if head[0].isupper() and len(head[0]) > 1 else "B" if head[0][0].isupper() else "a"
        shape = xxhash.xxh64_intdigest(kind + small) % (SHAPES - 1)
        found = xxhash.xxh64_intdigest(core or word) % WORDS << 16 | shape
        if len(self) >= MOST_CACHED:
            self.clear()
        self[word] = found
        return found


_known = Vocabulary()


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word tokens and shape tokens of all texts, and how many each text has."""
    split = [(t or "").split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    both = np.fromiter(map(_known.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
    word, shape = both >> 16, (both & 0xFFFF) + WORDS
    repeats = np.zeros(len(word), bool)
    repeats[1:] = (word[1:] == word[:-1]) & (shape[1:] == shape[:-1])
    starts = np.cumsum(counts) - counts
    repeats[starts[counts > 0]] = False
    shape[repeats] = REPEATED
    return word, shape, counts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of every token's index vector."""
    n = np.arange(TOKENS * NONZERO, dtype=np.uint64).reshape(TOKENS, NONZERO)
    h = mix64(n + np.uint64(1))
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1, -1)


def context_sums(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums of neighbours' index vectors by token, and how often each token occurs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        sums, seen = np.zeros(TOKENS * WIDTH, np.int64), np.zeros(TOKENS, np.int64)
        task = None
        for batch in batches:
            for part in slices(batch):
                word, shape, counts = tokens_of(part.column(0).to_pylist())
                if task is None:
                    task = int(xxhash.xxh32_intdigest(str(len(word)) + str(word[:8].tolist())))
                ends = np.cumsum(counts)
                inner = np.ones(max(len(word) - 1, 0), bool)
                inner[(ends[:-1] - 1)[(ends[:-1] > 0) & (ends[:-1] < len(word))]] = False
                for stream in (word, shape):
                    left, right = stream[:-1][inner], stream[1:][inner]
                    for a, b in ((left, right), (right, left)):
                        at = a[:, None] * WIDTH + places[b]
                        np.add.at(sums, at.reshape(-1), signs[b].reshape(-1))
                    seen += np.bincount(stream, minlength=TOKENS)
        if task is not None:
            for chunk in range(CHUNKS):
                low = chunk * (TOKENS // CHUNKS)
                met = np.flatnonzero(seen[low : low + TOKENS // CHUNKS])
                rows = np.concatenate([sums.reshape(TOKENS, WIDTH)[met + low], seen[met + low, None]], 1)
                if len(met):
                    yield one_part(chunk, task % FAN_IN, met, rows)
        del sums, seen
        give_back()

    def one_part(chunk: int, salt: int, met: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        small = not len(rows) or max(rows.max(), -rows.min()) < 1 << 31
        arrays = [pa.array([chunk], pa.int32()), pa.array([salt], pa.int32())]
        arrays += [pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in ((met, "<i4"), (rows, "<i4" if small else "<i8"))]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "salt", "met", "part"])

    def read_part(met: bytes, part: bytes) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(met, "<i4")
        kind = "<i4" if len(part) == 4 * len(at) * (WIDTH + 1) else "<i8"
        return at, np.frombuffer(part, kind).reshape(-1, WIDTH + 1)

    def total(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((TOKENS // CHUNKS, WIDTH + 1), np.int64)
        for batch in groups:
            for met, part in zip(batch.column("met").to_pylist(), batch.column("part").to_pylist(), strict=True):
                at, rows = read_part(met, part)
                out[at] += rows
        met = np.flatnonzero(out[:, WIDTH])
        yield one_part(key[0].as_py(), key[1].as_py() if len(key) > 1 else 0, met, out[met])

    schema = "chunk int, salt int, met binary, part binary"
    parts = df.select(text).mapInArrow(add, schema)
    half = parts.groupBy("chunk", "salt").applyInArrow(total, schema)
    both = np.zeros((TOKENS, WIDTH + 1))
    for r in half.groupBy("chunk").applyInArrow(total, schema).collect():  # at most TOKENS rows of numbers
        at, numbers = read_part(r["met"], r["part"])
        both[at + r["chunk"] * (TOKENS // CHUNKS)] = numbers
    return both[:, :WIDTH], both[:, WIDTH]


def word_vectors(sums: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Context vectors, unit length, without what all of a stream share, common tokens weighted down."""
    out = np.zeros((TOKENS, WIDTH), np.float32)
    for part in (slice(0, WORDS), slice(WORDS, TOKENS)):
        n = seen[part]
        mean = sums[part] / np.maximum(n, 1)[:, None]
        if n.sum():
            mean = mean - (mean * n[:, None]).sum(0) / n.sum()
        unit = mean / np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
        share = n / max(n.sum(), 1)
        out[part] = (unit * (0.01 / (0.01 + share))[:, None]) * (n > 0)[:, None]
    return out


def pooled(df: DataFrame, vectors: np.ndarray, text: str, id_col: str) -> DataFrame:
    """Rows (id, features): mean word vector, then mean shape vector."""
    shared = df.sparkSession.sparkContext.broadcast(vectors)  # TOKENS x WIDTH floats at any input size

    def pool(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, shape, counts = tokens_of(batch.column(1).to_pylist())
        full, starts = counts > 0, np.cumsum(counts) - counts
        out = np.zeros((len(counts), 2 * WIDTH), np.float32)
        if full.any():
            for k, stream in enumerate((word, shape)):
                sums = np.add.reduceat(shared.value[stream], starts[full], axis=0)
                out[full, k * WIDTH : (k + 1) * WIDTH] = sums / counts[full, None]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float32()))], names)

    names = [id_col, "features"]
    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text), pool, f"`{id_col}` {kind}, features array<float>")


class Network:
    """Standardised input, tanh layer, logistic output over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, seed: int = 7) -> None:
        self.constant = None
        if len(x) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        order = rng.permutation(len(x))
        for_temperature, for_weights = order[: len(x) // 5], order[len(x) // 5 :]
        z, t = (x[for_weights] - self.mean) / self.scale, y[for_weights]
        n = x.shape[1]
        self.params = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(z), min(512, len(z)))
            grads = self.gradients(z[at], t[at])
            for p, g, (m, v) in zip(self.params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if len(for_temperature):
            logits, t = self.logits(x[for_temperature]), y[for_temperature]
            grid = np.geomspace(0.25, 8, 41)
            loss = [np.logaddexp(0, np.where(t > 0.5, -logits, logits) / g).mean() for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def gradients(self, z: np.ndarray, t: np.ndarray, decay: float = 1e-3) -> list[np.ndarray]:
        w1, b1, w2, b2 = self.params
        h = np.tanh(z @ w1 + b1)
        d = (1 / (1 + np.exp(-(h @ w2 + b2))) - t) / len(t)
        back = d[:, None] * w2 * (1 - h * h)
        return [z.T @ back + decay * w1, back.sum(0), h.T @ d + decay * w2, d.sum(keepdims=True)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.params
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def score_quality(
    df: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality"
) -> DataFrame:
    """Columns id, held_out, score, predicted; one row a row of ``df``."""
    sc = ship(df.sparkSession).sparkContext
    features = save(pooled(df, word_vectors(*context_sums(df, text)), text, id_col), "quality-features")
    known = (
        labels.where(F.col(label).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg((F.avg(label) >= 0.5).cast("double").alias("_label"))
    )
    fit = (
        features.join(known, id_col)
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(MOST_LABELLED)
        .select("features", "_label")
        .toPandas()
    )
    x = np.array(fit["features"].tolist(), np.float64).reshape(len(fit), 2 * WIDTH)
    network = sc.broadcast(Network(x, fit["_label"].to_numpy(np.float64)))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        p = network.value.probability(x.astype(np.float64))
        arrays = [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= ACCEPT).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "held_out", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    ready = features.select(id_col, held_out(id_col).alias("held_out"), "features")
    return arrow_map(ready, judge, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def op3_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
