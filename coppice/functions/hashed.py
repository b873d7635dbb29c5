"""Terms of normalised texts as 64-bit hashes, whole batches at a time, equal to those of ``feature_terms``.

Two different terms get the same hash with a chance of one in 2**64: among the 5 * 10**8
distinct terms of some million records, one such pair is expected in 150 such runs.
"""

from __future__ import annotations

import numpy as np

from coppice.functions.packing import spans
from coppice.functions.text import GRAM_CHARS, GRAM_PREFIX, STOPWORDS

STEP = 0xC2B2AE3D27D4EB4F  # odd, so it has an inverse modulo 2**64
LEFT, RIGHT, LAST = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)
PAIR, GRAM = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> list[np.ndarray]:
    """STEP ** i and its inverse for i below n or more."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _powers[:] = []
        for base in (STEP, pow(STEP, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers


def word_hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(chars))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(chars + np.uint64(1)) * up[: len(chars)], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, starts and ends of all their words, and the text of each word."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    blank = (chars == 32) | (chars == 10)
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    return chars, starts, ends, np.searchsorted(np.flatnonzero(chars == 10), starts)


def hashed_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of normalised texts, repeats kept, and the place of the text of each; equal ones in order of texts."""
    return found_terms(texts)[:2]


def found_terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """The same, and what ``spots_of`` needs to spell them."""
    chars, starts, ends, of = words_of(texts)
    wide = chars.astype(np.uint64)
    words = word_hashes(wide, starts, ends)
    kept = ((ends - starts > 1) | (chars[starts] > 127)) & (STOPPED[np.searchsorted(STOPPED, words) % len(STOPPED)] != words)
    starts, ends, of, words = starts[kept], ends[kept], of[kept], words[kept]
    near = of[1:] == of[:-1]
    pairs = mix64(words[:-1][near] * LEFT + words[1:][near] * RIGHT + PAIR)
    many = np.maximum(ends - starts - GRAM_CHARS, -1) + 1
    many[many == 1] = 0  # a word of four characters has no windows
    at = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())
    three = wide[at] | wide[at + 1] << np.uint64(21) | wide[at + 2] << np.uint64(42)
    grams = mix64(mix64(three + GRAM) + wide[at + 3] * LAST)
    return np.concatenate([words, pairs, grams]), np.concatenate([of, of[:-1][near], np.repeat(of, many)]), (chars, starts, ends, near, at)


def spots_of(starts: np.ndarray, ends: np.ndarray, near: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """Where each of the found terms is spelled: start and size of its first word, of its second; of a window the last is -1."""
    size = ends - starts
    none, window = np.zeros(len(starts), np.int64), np.full(len(at), GRAM_CHARS)
    columns = (
        np.concatenate([starts, starts[:-1][near], at]) + base,
        np.concatenate([size, size[:-1][near], window]),
        np.concatenate([none, starts[1:][near] + base, np.zeros(len(at), np.int64)]),
        np.concatenate([none, size[1:][near], np.full(len(at), -1)]),
    )
    return np.stack(columns).astype(np.int32)


def spelled(chars: np.ndarray, spots: np.ndarray) -> bytes:
    """The terms at these spots in UTF-8, each ended by a line break."""
    start, size, second, more = spots.astype(np.int64)
    window, pair = more < 0, more > 0
    total = size + len(GRAM_PREFIX) * window + (1 + more) * pair + 1
    at = np.cumsum(total) - total
    out = np.full(total.sum(), ord(" "), "<u4")
    out[at + total - 1] = ord("\n")
    for i, c in enumerate(GRAM_PREFIX):
        out[at[window] + i] = ord(c)
    at += len(GRAM_PREFIX) * window
    out[spans(at, size)] = chars[spans(start, size)]
    out[spans((at + size + 1)[pair], more[pair])] = chars[spans(second[pair], more[pair])]
    return out.tobytes().decode("utf-32-le").encode()


def _stopped() -> np.ndarray:
    chars, starts, ends, _ = words_of(STOPWORDS)
    return np.unique(word_hashes(chars.astype(np.uint64), starts, ends))


STOPPED = _stopped()
