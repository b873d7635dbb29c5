"""Shingle sets of whole texts as sorted arrays of 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import numpy as np

from coppice.llm.common import mix64

STEP = 0xC2B2AE3D27D4EB4F  # odd, so it has an inverse modulo 2**64
STEP_INVERSE = pow(STEP, -1, 1 << 64)
MOST_WORDS = 16
MIXERS = mix64(np.arange(1, MOST_WORDS + 1, dtype=np.uint64)) | np.uint64(1)

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """STEP ** i and its inverse for i below n or more."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _powers[:] = []
        for base in (STEP, STEP_INVERSE):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and for each text the index of its first word; one more entry at the end."""
    parts = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    blank = _space[data]
    before = np.concatenate([[True], blank[:-1]])
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    up, down = powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    return mix64((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct shingles of ``width`` words.

    Fewer words make one shingle of the whole sequence; no words, no shingles.
    """
    words, first = word_hashes(texts)
    many = max(len(words) - width + 1, 0)
    grams = np.zeros(many, np.uint64)
    for k in range(width):
        grams += words[k : k + many] * MIXERS[k]
    grams = mix64(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mix64(h * MIXERS[0] + words[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
