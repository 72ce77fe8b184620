"""Packing documents into fixed-length sequences.

Documents are cut at multiples of the sequence length; what is left of each is one shorter piece. Lengths are few (fewer than the
sequence length), so the histogram of pieces is small whatever the corpus, and the packing is decided on it alone:

1. Enumerate shallow combinations (one to three lengths) that fill a sequence exactly.
2. Non-negative least squares: how often to use each so that together they use up the histogram. Round down.
3. Pack what remains greedily, again by length: the longest with the longest that still fit, as often as counts allow.

The plan is a bounded table of slots: of the pieces of one length, those ranked ``lo <= rank < hi`` go to sequences
``base + rank - lo`` at one offset. Pieces get ranks by salted counting, so a length that a third of all pieces share is spread.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstone.llm.common import arrow_map, pick, staged
from panelstone.llm.pieces import PATTERN
from panelstone.llm.token_counts import TOKENIZER, byte_alphabet, tokenizer_path

SEQUENCE, END_ID, SALTS = 2048, 1, 64
# Combinations offered to the solver for each length, and its rounds.
PARTNERS, ROUNDS = 6, 200
# ``tiktoken`` fails on a million white characters in a row: from this many on, a run is cut out before it sees the text.
LONG_SPACE = 10_000
# What the pattern's ``\s`` stands for: Unicode's White_Space, which Python's own ``\s`` goes beyond.
_LONG_RUN = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_SPACE},}}")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary and its special string are read from the tokenizer's own file; ``tiktoken`` applies them, with the same ids (tested)
    in a quarter of the time.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def encode(self, text: str) -> bytes:
        if len(text) >= LONG_SPACE and _LONG_RUN.search(text):
            return b"".join(self.pieces(text))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a text with overlong white runs. The pattern makes one piece of such a run without its last character, which may begin
        the next piece; at the end of a stretch between special strings the whole run is the piece."""
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                yield np.array([self.special[part]], dtype="<u4").tobytes()
                continue
            at = 0
            for m in _LONG_RUN.finditer(part):
                stop = m.end() - (m.end() < len(part))
                yield self.plain(part[at : m.start()])
                yield np.array(self.encoding._encode_single_piece(part[m.start() : stop]), dtype="<u4").tobytes()
                at = stop
            yield self.plain(part[at:])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_pieces(rows: DataFrame, sequence: int, path: str | None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` for every piece, in one pass."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def work(cols):
        own = encoder(path or tokenizer_path(TOKENIZER))
        out = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
            ids = (own.encode(text) if text else b"") + end
            n = len(ids) // 4
            for start in range(0, n, sequence):
                length = min(sequence, n - start)
                crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                for name, value in zip(out, (doc_id, start, length, crc, n), strict=True):
                    out[name].append(value)
        return out

    return arrow_map(rows, work, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(counts: np.ndarray, sequence: int) -> list[tuple[int, ...]]:
    """Sets of two or three lengths in use that fill a sequence exactly; longest first."""
    used = np.flatnonzero(counts)
    have = set(used.tolist())
    busy = sorted(have, key=lambda x: -counts[x])
    out = {(a, sequence - a) for a in used.tolist() if 2 * a >= sequence and sequence - a in have}
    for a in used.tolist():
        offered = 0
        for b in busy:
            c = sequence - a - b
            if c in have:
                out.add(tuple(sorted((a, b, c), reverse=True)))
                offered += 1
                if offered == PARTNERS:
                    break
    return sorted(out, reverse=True)


def least_squares(patterns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used closest to the histogram (projected, accelerated gradient)."""
    k = len(patterns)
    column = np.repeat(np.arange(k), [len(p) for p in patterns])
    row = np.array([x for p in patterns for x in p])
    size = len(counts)
    uses = np.bincount(row, minlength=size)
    x = np.zeros(k)
    # 1 / (largest row sum times largest column sum) bounds the step.
    step = 1.0 / max(1.0, np.sqrt(float(uses.max()) * 3.0) ** 2)
    y, t = x.copy(), 1.0
    for _ in range(ROUNDS):
        short = np.bincount(row, weights=y[column], minlength=size) - counts
        new = np.maximum(0.0, y - step * np.bincount(column, weights=short[row], minlength=k))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(histogram: dict[int, int], sequence: int) -> list[tuple[int, int, int, int, int]]:
    """Slots ``length, lo, hi, base, offset`` that use every piece of the histogram once."""
    counts = np.zeros(sequence + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    chosen: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        if times > 0:
            chosen.append((pattern, times))
            for x in pattern:
                counts[x] -= times

    take((sequence,), int(counts[sequence]))
    patterns = combinations(counts, sequence)
    if patterns:
        solution = least_squares(patterns, counts.astype(float))
        for i in np.argsort(-solution, kind="stable"):
            pattern = patterns[i]
            need = {x: pattern.count(x) for x in pattern}
            take(pattern, min([int(solution[i]), *(int(counts[x]) // n for x, n in need.items())]))
    # Each turn uses up at least one length.
    for longest in range(sequence, 0, -1):
        while counts[longest] > 0:
            pattern, room, left = [longest], sequence - longest, {longest: int(counts[longest]) - 1}
            fit = room
            while room and fit:
                fit = min(fit, room)
                if left.get(fit, int(counts[fit])) > 0:
                    pattern.append(fit)
                    left[fit] = left.get(fit, int(counts[fit])) - 1
                    room -= fit
                else:
                    fit -= 1
            need = {x: pattern.count(x) for x in pattern}
            take(tuple(pattern), min(int(counts[x]) // n for x, n in need.items()))
    slots, base, used = [], 0, np.zeros(sequence + 1, dtype=np.int64)
    for pattern, times in chosen:
        offset = 0
        for x in pattern:
            slots.append((x, int(used[x]), int(used[x]) + times, base, offset))
            used[x] += times
            offset += x
        base += times
    return slots


def place(pieces: DataFrame, sequence: int) -> DataFrame:
    """Add ``sequence_id, offset`` to a written table of pieces."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)))
    cells = staged(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))  # at most length * salt rows
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    slots = spark.createDataFrame(plan(histogram, sequence), "length long, lo long, hi long, base long, offset long")
    before = cells.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("local", local).join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local"))
    # Slots are few: every pattern uses up a length or is one of the solver's, both bounded by the sequence length.
    met = ranked.join(F.broadcast(slots), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return met.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, path: str | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece.

    A document is its token ids and then id 1, so a null or empty text is one token. Every id lies in one piece; a sequence holds at
    most ``sequence`` ids, gapless from 0. Repeated rows are packed as often as they occur, a null id like any other; an empty table
    gives an empty result.
    """
    pieces = staged(cut_pieces(pick(df, doc_id=id_col, text=text_col), sequence, path))
    return place(pieces, sequence)
