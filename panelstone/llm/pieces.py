"""Cutting text where a byte-level tokenizer certainly cuts it, so that what stands between the cuts can be looked up.

The pre-tokenizer's pieces never reach across a single space between two non-spaces: the space starts a new piece. Text is cut there,
each chunk is worked out once, and a bounded memory keeps the results of frequent chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Longest chunk that is remembered, and how many are.
REMEMBER_CHARS, REMEMBER = 48, 800_000

_TWO_SPACES = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class Memory(dict):
    """Results by chunk. It is emptied when full; a chunk too long to be common is worked out anew each time."""

    def __init__(self, work: Callable, size: int = REMEMBER):
        self.work, self.size = work, size

    def __missing__(self, chunk: str):
        out = self.work(chunk)
        if len(chunk) <= REMEMBER_CHARS:
            self.keep(chunk, out)
        return out

    def keep(self, chunk: str, out) -> None:
        if len(self) >= self.size:
            self.clear()
        self[chunk] = out


@lru_cache(maxsize=1)
def piece_pattern():
    import regex

    return regex.compile(PATTERN)


def chunks_of(text: str) -> tuple[str, list[str]]:
    """The first chunk, and the others without the single space that each begins with."""
    parts = _SAFE_CUT.split(text) if _TWO_SPACES.search(text) else text.split(" ")
    return parts[0], parts[1:]


def segments_of(text: str, special: str | None) -> list[str]:
    """Stretches between occurrences of a special string, which is cut out before anything else."""
    return text.split(special) if special and special in text else [text]
