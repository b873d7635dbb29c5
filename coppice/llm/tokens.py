"""Byte-level BPE ids of whole texts, fast enough for every document.

The vocabulary of a tokenizer file is loaded as merge ranks, which gives the
tokenizer's own ids (tests compare).  The pre-token pattern needs a look-ahead
only where two white-space characters meet; other texts take the pattern
without it, which runs on a plain automaton.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property
from pathlib import Path
from typing import ClassVar

import tiktoken

DOUBLE_SPACE = re.compile(r"\s\s")
#: The pre-token pattern of this family of vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
PATTERN = WORDS + r"|\s+(?!\S)|\s+"
PATTERN_OF_SINGLE_SPACES = WORDS + r"|\s+"


def byte_of_char() -> dict[str, int]:
    """The printable characters that stand for bytes in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to id from a tokenizer file, without its special tokens."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {x["content"] for x in spec.get("added_tokens", [])}
    of = byte_of_char()
    return {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


class BpeEncoder:
    """Ids as little-endian uint32 bytes; special-token strings in a text are ordinary text."""

    _made: ClassVar[dict[str, BpeEncoder]] = {}

    def __init__(self, path: str) -> None:
        self.path = path

    def with_pattern(self, pattern: str) -> tiktoken.Encoding:
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=vocabulary(self.path), special_tokens={})

    @cached_property
    def full(self) -> tiktoken.Encoding:
        return self.with_pattern(PATTERN)

    @cached_property
    def single(self) -> tiktoken.Encoding:
        return self.with_pattern(PATTERN_OF_SINGLE_SPACES)

    @classmethod
    def of(cls, path: str) -> BpeEncoder:
        """One encoder a process, for every task of that worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of ``text``, four bytes each."""
        if not text:
            return b""
        encoding = self.full if DOUBLE_SPACE.search(text) else self.single
        return array("I", encoding.encode_ordinary(text)).tobytes()
