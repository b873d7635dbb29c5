"""Language identification with interpolated Kneser-Ney character models.

Counting: one Arrow pass turns texts into character n-grams of the top order,
counts them by language inside each task, and a DataFrame aggregate adds the
counts over all tasks; nothing is sampled.  Only documents outside the held-out
quarter and with a language count.

The model: for every language, interpolated Kneser-Ney probabilities of order 4
(continuation counts below the top order, absolute discounts from counts of
counts), kept for all languages side by side in arrays sorted by n-gram hash.
Looking up a character is one binary search for all languages; n-grams unseen in
training fall back over the context's weight to the next order.

No n-gram is left out.  A model of more than ``MOST_CELLS`` numbers is dealt into
shards by the two characters before the predicted one: all that a character can
fall back to, but the short lowest orders, lies in one shard.  Discounts, the
alphabet and the two lowest orders come from DataFrames over all counts.  A task
scores a few texts with one shard after another, so it holds one at a time.

The prediction is the language of lowest cross-entropy per character.  The score
is its softmax probability at a temperature chosen over all training documents.
A text is rejected (column ``rejected``, language still given) if its best
cross-entropy lies above what all but a small share of the training documents of
that language have, plus a margin; texts without letters are ``und`` and rejected.

Null, empty and letterless texts: ``und`` with score 0.  Without any training
rows every text is ``und``.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, give_back, held_out, mix64, slices, table
from coppice.session import save, ship, spread

ORDER = 4
UNKNOWN = "und"
#: Probabilities (rows of n-grams times languages) of one shard; a larger model has more shards.
MOST_CELLS = 8_000_000
#: Slices of texts that a task scores with a shard before it loads the next one.
SCORED_SLICES = 16
REJECT_SHARE = 0.001
REJECT_MARGIN = 1.0
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
EDGE = 32  # a space stands for everything that isn't a letter, and for both ends

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with single spaces around words, all texts in one array; the start of each text.

    Every text begins with ``ORDER - 1`` edges, so no n-gram that ends inside a text begins in another.
    """
    lead = " " * ORDER
    padded = [lead + (t or "").lower() + " " for t in texts]
    joined, lengths = "".join(padded), np.fromiter(map(len, padded), np.int64, len(texts))
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[codes], codes, EDGE)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    first = np.zeros(len(codes), bool)
    for k in range(ORDER - 1):
        first[starts + k] = True
    keep = (codes != EDGE) | first
    keep[1:] |= codes[:-1] != EDGE  # one space after a word
    keep[starts] = True
    return codes[keep], (np.cumsum(keep) - 1)[starts]


def gram_hashes(codes: np.ndarray, order: int, ends: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that ends at each of ``ends``; the first ``order - 1`` positions reach over the start."""
    padded = np.concatenate([np.full(ORDER, EDGE, codes.dtype), codes])
    h = np.zeros(len(ends), np.uint64)
    for k in range(order - 1, -1, -1):
        h = mix64(h + padded[ends + (ORDER - k)].astype(np.uint64) + np.uint64(1))
    return h


def predicted(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions that are predicted: all but the leading edges."""
    out = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        out[np.minimum(starts + k, len(codes) - 1)] = False
    return out


def count_grams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows (lang, gram, n) over all rows of ``df``; grams are strings of ``ORDER`` characters."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pandas()
        parts = []
        for language, group in texts.groupby(batch.column(1).to_pandas()):
            codes, starts = symbols(group.tolist())
            at = np.flatnonzero(predicted(codes, starts))
            seen = pd.Series(at).groupby(gram_hashes(codes, ORDER, at), sort=False).agg(["first", "size"])
            ends = seen["first"].to_numpy()
            grams = np.stack([codes[ends - k] for k in range(ORDER - 1, -1, -1)], 1).astype("<u4")
            whole = grams.tobytes().decode("utf-32-le", "replace")
            parts.append(
                pd.DataFrame(
                    {
                        "lang": language,
                        "gram": [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)],
                        "n": seen["size"].to_numpy(),
                    }
                )
            )
        if not parts:
            return None
        return pa.RecordBatch.from_pandas(pd.concat(parts), preserve_index=False)

    counted = arrow_map(df.select(text, lang), count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Of one order: sorted hashes of n-grams with log probabilities, and of contexts with log weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


@dataclass
class KneserNey:
    languages: list[str]
    levels: list[Level]  # from order 1 up
    floor: float  # log probability of a character never seen

    def log_probabilities(self, codes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """By position (all, or those in ``at``) and language."""
        ends = np.arange(len(codes)) if at is None else at
        out = np.zeros((len(ends), len(self.languages)), np.float32)
        left = np.arange(len(ends))
        for order in range(len(self.levels), 0, -1):
            level = self.levels[order - 1]
            at, found = lookup(level.grams, gram_hashes(codes, order, ends[left]))
            out[left[found]] += level.logp[at[found]]
            left = left[~found]
            if not len(left):
                return out
            if order > 1:
                at, found = lookup(level.contexts, gram_hashes(codes, order - 1, ends[left] - 1))
                out[left[found]] += level.weight[at[found]]
            else:
                out[left] += level.weight[0]  # the empty context
        out[left] += self.floor
        return out


@dataclass
class Shard:
    """The part of a model for characters whose ``place`` lies from ``low`` up to below ``high``."""

    low: int
    high: int
    model: Broadcast


@dataclass
class Whole:
    """What a shard can't know of the whole model: counts of the two lowest orders, discounts by order."""

    languages: list[str]
    lowest: dict[int, pd.DataFrame]
    discounts: dict[int, np.ndarray]


def places(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The two characters before each of ``ends`` as one number, the nearer one first."""
    return codes[ends - 1].astype(np.int64) << 21 | codes[ends - 2].astype(np.int64)


def place_of(gram: Column) -> Column:
    return F.shiftleft(F.ascii(F.substr(gram, F.lit(3), F.lit(1))).cast("long"), 21) + F.ascii(F.substr(gram, F.lit(2), F.lit(1)))


def cross_entropies(shards: list[Shard], groups: list[list[str | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per group of texts: by text and language, nats a character; and how many letters each text has."""
    prepared = [symbols(texts) for texts in groups]
    ends = [np.flatnonzero(predicted(*p)) for p in prepared]
    totals: list = [0.0] * len(groups)
    for shard in shards:
        model = shard.model.value
        for g, (codes, starts) in enumerate(prepared):
            at = ends[g]
            if len(shards) > 1:
                place = places(codes, at)
                at = at[(place >= shard.low) & (place < shard.high)]
            logp, row = model.log_probabilities(codes, at), np.searchsorted(starts, at, "right") - 1
            totals[g] = totals[g] + np.stack([np.bincount(row, x, len(starts)) for x in logp.T], 1)
        if len(shards) > 1:
            del model
            vars(shard.model).pop("_value", None)  # one shard in memory at a time
    out = []
    for (codes, starts), at, total in zip(prepared, ends, totals, strict=True):
        n = np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(starts))
        own = np.add.reduceat((codes != EDGE).astype(np.int64), starts)
        out.append((-total / np.maximum(n, 1)[:, None], own))
    return out


def lookup(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
    return at, table_[at] == keys


def coded(counts: pd.DataFrame, order: int, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, characters, count) of (lang, gram, n) rows."""
    which = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    codes = np.frombuffer("".join(counts["gram"]).encode("utf-32-le", "replace"), "<u4").reshape(-1, order)
    return which, codes, counts["n"].to_numpy(np.float64)


def discounts_of(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.9)


def kneser_ney(counts: pd.DataFrame, whole: Whole | None = None) -> KneserNey:
    """Build the model from (lang, gram, n) rows of the top order, or a shard of it with what the whole has."""
    languages = sorted(counts["lang"].unique()) if whole is None else whole.languages
    which, codes, n = coded(counts, ORDER, languages)
    tables = []  # of each order from the top: (language, characters, count)
    for order in range(ORDER, 0, -1):
        tables.append((which, codes, n))
        if order == 1:
            break
        if whole is not None and order - 1 in whole.lowest:
            which, codes, n = coded(whole.lowest[order - 1], order - 1, languages)
            continue
        # below the top, a count is the number of different characters seen before
        frame = pd.DataFrame(codes[:, 1:]).assign(which=which)
        groups = frame.groupby([*range(order - 1), "which"], sort=False)
        first, size = groups.head(1).index.to_numpy(), groups.ngroup().value_counts().sort_index().to_numpy()
        which, codes, n = which[first], codes[first, 1:], size.astype(np.float64)
    k = len(languages)
    alphabet = len(np.unique(tables[-1][1]))
    floor = -np.log(alphabet + 1)
    lower: tuple[np.ndarray, np.ndarray] | None = None
    levels = []
    for order in range(1, ORDER + 1):
        which, codes, n = tables[ORDER - order]
        keys = row_hashes(codes)
        grams, gram_at = np.unique(keys, return_inverse=True)
        heads = row_hashes(codes[:, :-1])
        contexts, context_at = np.unique(heads, return_inverse=True)
        some = np.zeros(len(grams), np.int64)
        some[gram_at] = np.arange(len(keys))  # a row that has each gram
        amount, total, kinds = np.zeros((len(grams), k)), np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
        np.add.at(amount, (gram_at, which), n)
        np.add.at(total, (context_at, which), n)
        np.add.at(kinds, (context_at, which), 1)
        if whole is None:
            discount = discounts_of(*(np.bincount(which, n == i, k) for i in (1, 2)))
        else:
            discount = whole.discounts[order]
        seen = total > 0
        weight = np.where(seen, discount * kinds / np.maximum(total, 1), 1.0)
        if lower is None:
            below = np.full((len(grams), k), np.exp(floor))
        else:
            at, _ = lookup(lower[0], row_hashes(codes[some][:, 1:]))
            below = lower[1][at]
        here = context_at[some]
        top = np.maximum(amount - discount, 0) / np.maximum(total[here], 1)
        p = np.where(seen[here], top, 0) + weight[here] * below
        levels.append(Level(grams, np.log(p).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
        lower = grams, p
    return KneserNey(languages, levels, float(floor))


def row_hashes(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = mix64(h + codes[:, k].astype(np.uint64) + np.uint64(1))
    return h


def train(df: DataFrame, text: str, lang: str, id_col: str) -> tuple[list[str], list[Shard]]:
    """A model, in shards, from all rows with a text and a language that aren't held out."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(id_col))
    counts = save(count_grams(rows, text, lang), "lang-grams")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not languages:
        return [], []
    share = df.sparkSession.sparkContext.broadcast
    parts = -(-counts.count() * len(languages) // MOST_CELLS)
    if parts == 1:
        model = kneser_ney(counts.orderBy("lang", "gram").toPandas())
        return languages, [Shard(0, 1 << 62, share(model))]
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts, over all n-grams
        shorter = levels[order + 1].select("lang", F.substr("gram", F.lit(2), F.lit(order)).alias("gram"))
        levels[order] = save(shorter.groupBy("lang", "gram").agg(F.count("*").alias("n")), "lang-grams")
    discounts = {}
    for order, level in levels.items():
        few = {r[0]: r[1:] for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()}
        discounts[order] = discounts_of(*np.array([few[x] for x in languages], np.float64).T)
    placed = counts.withColumn("place", place_of(F.col("gram")))
    cuts = placed.agg(F.percentile_approx("place", [k / parts for k in range(1, parts)], 100 * parts)).first()[0]
    bounds = [0, *sorted({int(x) for x in cuts} - {0}), 1 << 62]
    first = levels[1].orderBy("lang", "gram").toPandas()
    shards = []
    for high in bounds[1:]:
        low = shards[-1].high if shards else 0
        own = placed.where((F.col("place") >= low) & (F.col("place") < high)).select("lang", "gram", "n")
        before = F.ascii("gram").cast("long")
        second = levels[2].where((before >= low >> 21) & (before <= high >> 21))
        lowest = {2: second.orderBy("lang", "gram").toPandas(), 1: first}
        grams = own.orderBy("lang", "gram").toPandas()
        if len(grams):
            shards.append(Shard(low, high, share(kneser_ney(grams, Whole(languages, lowest, discounts)))))
    return languages, shards


def identify(df: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Columns id, held_out, lang_pred, score, cross_entropy, rejected; one row a row of ``df``."""
    ship(df.sparkSession)
    model_languages, shards = train(df, text, lang, id_col)
    base = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    if not shards:
        nothing = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double")}
        return base.withColumns(nothing | {"rejected": F.lit(True)}).drop("_lang", "_text")

    def measure(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (entropy, n) in zip(parts, cross_entropies(shards, [p.column(3).to_pylist() for p in parts]), strict=True):
            best = entropy.argmin(1)
            gap = entropy - entropy.min(1, keepdims=True)
            arrays = [
                *part.columns[:3],
                pa.array([model_languages[i] if k else None for i, k in zip(best, n, strict=True)], pa.string()),
                pa.array(entropy.min(1)),
                pa.array(list(gap * n[:, None]), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for part in slices(batch):
                waiting.append(part)
                if len(waiting) == (SCORED_SLICES if len(shards) > 1 else 1):
                    yield from measure(waiting)
                    waiting = []
        yield from measure(waiting)
        give_back()

    names = [id_col, "held_out", "_lang", "_best", "cross_entropy", "_gaps"]
    kinds = dict(df.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, held_out boolean, _lang {kinds[lang]}, _best string, cross_entropy double, _gaps array<double>"
    measured = save(base.mapInArrow(run, schema), "lang-scores")
    chance = lambda t: 1 / F.aggregate("_gaps", F.lit(0.0), lambda a, g: a + F.exp(-g / t))
    known = measured.where("not held_out and _lang is not null and _best is not null")
    right = lambda t: F.when(F.col("_lang") == F.col("_best"), chance(t)).otherwise(1 - chance(t))
    losses = known.agg(*[F.sum(-F.log(F.greatest(right(t), F.lit(1e-9)))) for t in TEMPERATURES]).first()
    temperature = min(zip(losses, TEMPERATURES, strict=True), key=lambda x: x[0] if x[0] is not None else 0)[1]
    limits = {
        r[0]: r[1] + REJECT_MARGIN
        for r in known.where("_lang = _best")
        .groupBy("_best")
        .agg(F.percentile_approx("cross_entropy", 1 - REJECT_SHARE, 10_000))
        .collect()
    }
    limit = F.lit(float("inf"))
    for language, most in limits.items():
        limit = F.when(F.col("_best") == language, F.lit(most)).otherwise(limit)
    return measured.select(
        id_col,
        "held_out",
        F.coalesce("_best", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("_best").isNull(), 0.0).otherwise(chance(temperature)).alias("score"),
        F.when(F.col("_best").isNotNull(), F.col("cross_entropy")).alias("cross_entropy"),
        (F.col("_best").isNull() | (F.col("cross_entropy") > limit)).alias("rejected"),
    )


def op6_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spread(table(spark, sf_dir, "documents")))
