"""Exact token counts of a byte-level BPE vocabulary without making the tokens.

Each piece of the pre-tokenizer starts as a linked list of byte symbols. A heap holds its adjacent pairs by merge rank; the lowest
is popped and merged until no pair is in the vocabulary. A text has as many tokens as initial symbols less merges. Work on a piece of
n bytes is O(n log n), so a megabyte without a space is no problem. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

from pyspark.sql import DataFrame

from panelstone.llm.common import arrow_map, pick
from panelstone.llm.pieces import Memory, chunks_of, piece_pattern, segments_of

TOKENIZER = "byte_bpe_50k.json"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairCounter:
    """Counts tokens of one vocabulary; remembers pieces and chunks within bounds."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        if len(self.special) > 1 or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("one plain special string at most is supported")
        self.letters = byte_alphabet()
        self.pieces = Memory(self.piece_tokens)
        self.chunks = Memory(lambda rest: self.chunk_tokens(" " + rest))

    def piece_tokens(self, piece: str) -> int:
        symbols = [self.letters[b] for b in piece.encode()]
        initial = len(symbols)
        return initial - self.merges(symbols)

    def merges(self, symbol: list[str]) -> int:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is left; the number of merges."""
        n, rank = len(symbol), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        done = 0
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            # A popped pair may be gone: one of its symbols was merged since.
            if symbol[i] is None or j >= n or rank.get((symbol[i], symbol[j])) != r:
                continue
            symbol[i], symbol[j] = symbol[i] + symbol[j], None
            after[i] = k = after[j]
            done += 1
            if k < n:
                before[k] = i
                if (r := rank.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return done

    def chunk_tokens(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, piece_pattern().findall(chunk)))

    def count(self, text: str) -> int:
        """Tokens of a text; each special string inside it is one token."""
        parts = segments_of(text, self.special[0] if self.special else None)
        total = len(parts) - 1
        for part in parts:
            first, rest = chunks_of(part)
            total += self.chunk_tokens(first) + sum(map(self.chunks.__getitem__, rest))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> BytePairCounter:
    """One counter for each Python worker."""
    return BytePairCounter(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null or empty text has no bytes and no tokens. Rows are independent: repeated rows give repeated results, a null id stays null,
    an empty table gives an empty result. ``path`` names the vocabulary file on every machine (default: the installed one).
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(cols):
        own = counter(path or tokenizer_path(TOKENIZER))
        texts = [t or "" for t in cols["text"]]
        n = [own.count(t) for t in texts]
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return arrow_map(rows, work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
