"""Exact repeated passages by recompression.

Texts are word sequences. Rounds replace maximal runs of a symbol, and adjacent pairs of a left and a right symbol, by new symbols. A
symbol's name is a hash of what it stands for, so all tasks agree on names without a dictionary, and a symbol's side is a bit of its
name in that round, so pairs never overlap. Equal stretches get equal symbols except near their ends, where the surroundings may
reach in. How far is known exactly for every window: its certain part starts and ends at symbols that nothing outside can change.

1. Every window takes the longest certain symbol of the highest round that has one (ties: largest hash, then leftmost). Symbols are
   short and some recur by chance, so the sign is the words that all windows have which hold the symbol about as far from their start.
   Equal windows have equal signs. Neighbouring windows with one sign at one place form one row: sign, range, hash of its words.
2. A sign that occurs once rules its windows out. Where all ranges of a sign have the same words, all their windows repeat.
3. Where they differ, each distinct range is written out by windows, and equal windows are counted by 128-bit hashes.
4. Words covered by a repeated window go.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstone.llm.common import arrow_map, mix, pick, staged, word_hashes, words_of
from panelstone.session import stacked

# More rounds make longer symbols, of which a window holds fewer: its choice then changes more often, and ranges are shorter.
STEPS = ("run", "pair", "pair", "pair")
# Words a symbol may stand for: longer ones would rarely lie inside a window.
LONGEST = 12
# Places of the symbol in the window, in so many steps at most, make signs of their own.
STEPS_IN_WINDOW = 2
# Words parsed at a time; a longer text is parsed alone.
BLOCK_WORDS = 64_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=4)
def _powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    base = int(_BASES[which])
    with np.errstate(over="ignore"):
        up = np.full(size, np.uint64(base))
        up[0] = 1
        down = np.full(size, np.uint64(pow(base, -1, 1 << 64)))
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def stretch_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the words ``start:stop`` for many stretches, from running sums."""
    size = 1 << max(10, int(len(h)).bit_length())
    up, down = _powers(size, which)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(h ^ _BASES[1 - which]) * up[: len(h)], dtype=np.uint64)])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def window_signs(h: np.ndarray, fixed: np.ndarray, window: int) -> np.ndarray:
    """Place of the chosen symbol of each window start ``0 .. len(h) - window``; ``fixed`` marks separators between texts.

    Windows that hold a separator get some symbol too; the caller leaves them out.
    """
    n = len(h)
    names, firm = h, fixed
    starts = np.arange(n + 1, dtype=np.int32)  # of symbols, with the end
    # The certain part of what lies from one word boundary to a later one starts at symbol ``low`` of the former and ends before symbol
    # ``high`` of the latter: either end depends on its own boundary only.
    low = high = starts
    levels = []
    for step, kind in enumerate(("word", *STEPS)):
        if kind != "word":
            lengths, m = np.diff(starts), len(names)
            edges = np.arange(m + 1, dtype=np.int32)
            keep = np.ones(m, dtype=bool)
            if kind == "run":
                head = np.ones(m, dtype=bool)
                head[1:] = (names[1:] != names[:-1]) | firm[1:]
                heads = np.flatnonzero(head).astype(np.int32)
                size = np.diff(np.append(heads, np.int32(m)))
                joined = (size > 1) & (size * lengths[heads] <= LONGEST)
                # The first and the last run of a certain part may go on outside.
                up, down = edges + 1, edges - 1
                for at, many in ((heads[size > 1], size[size > 1]),):
                    inside = np.repeat(at, many) + (np.arange(many.sum(), dtype=np.int32) - np.repeat(np.cumsum(many) - many, many).astype(np.int32))
                    up[inside], down[inside + 1] = np.repeat(at + many, many), np.repeat(at, many)
                up[m], down[0] = m, 0
                if joined.any():
                    at, many = heads[joined], size[joined]
                    names = names.copy()
                    names[at] = mix(names[at] * _BASES[0] + many.astype(np.uint64))
                    gone = np.repeat(at, many - 1) + 1 + (np.arange((many - 1).sum()) - np.repeat(np.cumsum(many - 1) - (many - 1), many - 1))
                    keep[gone] = False
            else:
                right = (mix(names ^ np.uint64(step * 0x51ED2705)) >> np.uint64(63)).astype(bool)
                free = (lengths < LONGEST) & ~firm
                up, down = edges.copy(), edges.copy()
                up[:-1] += right & free
                down[1:] -= ~right & free
                pair = ~right[:-1] & right[1:] & ~firm[:-1] & ~firm[1:] & (lengths[:-1] + lengths[1:] <= LONGEST)
                at = np.flatnonzero(pair)
                keep[at + 1] = False
                merged = names.copy()
                merged[at] = mix(mix(names[at]) * _BASES[1] + names[at + 1])
                names = merged
            before = np.zeros(m + 1, dtype=np.int32)  # symbols of the new round before each boundary
            np.cumsum(keep, out=before[1:])
            low, high = before[up][low], before[down][high]
            names, firm, starts = names[keep], firm[keep], np.append(starts[:-1][keep], np.int32(n))
        levels.append((low, high, names, starts))
    # The highest level with a certain symbol.
    level = np.zeros(n - window + 1, dtype=np.int8)
    for k, (a, b, *_rest) in enumerate(levels):
        level[a[: len(level)] < b[window:]] = k
    place = np.empty(len(level), dtype=np.int32)
    for k, (a, b, own, bounds) in enumerate(levels):
        these = np.flatnonzero(level == k)
        if not len(these):
            continue
        # Neighbouring windows often have one certain part.
        lo, hi = a[these], b[these + window]
        new = np.ones(len(these), dtype=bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        weight = (np.diff(bounds).astype(np.uint64) << np.uint64(56)) | (mix(own) >> np.uint64(8))
        place[these] = bounds[_range_argmax(weight, lo[new], hi[new])][np.cumsum(new) - 1]
    return place


def _range_argmax(weight: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Leftmost place of the largest weight in each ``lo:hi`` (not empty), by doubling."""
    out = np.empty(len(lo), dtype=np.int64)
    span = hi - lo
    best, width = np.arange(len(weight), dtype=np.int64), 1
    while True:
        these = np.flatnonzero((span >= width) & (span < 2 * width))
        if len(these):
            i, j = best[lo[these]], best[hi[these] - width]
            out[these] = np.where(weight[j] > weight[i], j, i)
        if width * 2 > span.max():
            return out
        i, j = best[:-width], best[width:]
        best = np.where(weight[j] > weight[i], j, i)
        width *= 2


def parse_texts(texts: list[np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """Rows ``text number, sign, stretch hash, first window, last window`` of several texts parsed as one sequence."""
    step = window // STEPS_IN_WINDOW + 1
    bounds = np.cumsum([0, *[len(x) + 1 for x in texts]])
    h, fixed = np.zeros(bounds[-1], dtype=np.uint64), np.zeros(bounds[-1], dtype=bool)
    for x, at in zip(texts, bounds, strict=False):
        h[at : at + len(x)] = x
    fixed[bounds[1:] - 1] = True
    place = window_signs(h, fixed, window)
    n = len(place)
    starts = np.arange(n)
    stop = np.repeat(bounds[1:] - 1, np.diff(bounds))[:n]
    good = starts + window <= stop
    # How far the symbol lies in the window, in steps: windows that agree in it have all but the last step of words in common.
    steps = (place - starts) // step
    new = np.ones(n, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (steps[1:] != steps[:-1]) | ~good[:-1]
    first = np.flatnonzero(new & good)
    # A range ends where the next one starts, or where windows end.
    last = np.append(np.flatnonzero(new)[1:], n)[np.searchsorted(np.flatnonzero(new), first)]
    last = np.minimum(last, stop[first] - window + 1) - 1
    text = np.searchsorted(bounds, first, side="right") - 1
    core = place[first] - steps[first] * step
    sign = mix(stretch_hashes(h, core, core - step + 1 + window, 1) + steps[first].astype(np.uint64))
    return text, sign, stretch_hashes(h, first, last + window), first - bounds[text], last - bounds[text]


def kept_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def parsed(rows: DataFrame, window: int) -> DataFrame:
    """One pass over ``doc_id, key, text``: a row for each text (``sign`` null), and the ranges of its signs."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, key long, n long, sha string, sign long, stretch long, first int, last int"

    def work(cols):
        words = [words_of(text) for text in cols["text"]]
        n = len(words)
        ranges, block, size = [], [], 0
        for i, own in enumerate(words):
            if len(own) >= window:
                block.append(i)
                size += len(own)
            if block and (size >= BLOCK_WORDS or i == n - 1):
                text, *rest = parse_texts([word_hashes(words[j]) for j in block], window)
                ranges.append((np.array(block)[text], *rest))
                block, size = [], 0
        text, sign, stretch, first, last = (np.concatenate(x) for x in zip(*ranges, strict=True)) if ranges else [np.empty(0, dtype=np.int64)] * 5
        of = pa.array(np.concatenate([np.arange(n), text]))
        blank, none = pa.nulls(len(text)), pa.nulls(n)

        def below(values, none=none):
            return pa.concat_arrays([none.cast(pa.int64()), pa.array(values.astype(np.int64, copy=False))])

        return {
            "doc_id": pa.array(cols["doc_id"]).take(of), "key": pa.array(cols["key"], pa.int64()).take(of),
            "n": pa.concat_arrays([pa.array([len(x) for x in words], pa.int64()), blank.cast(pa.int64())]),
            "sha": pa.concat_arrays([pa.array([kept_digest(x) for x in words], pa.string()), blank.cast(pa.string())]),
            "sign": below(sign.view(np.int64)), "stretch": below(stretch.view(np.int64)),
            "first": below(first).cast(pa.int32()), "last": below(last).cast(pa.int32()),
        }

    return arrow_map(rows, work, schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row (``kept_text`` null where nothing went).

    A word ``[^\\x20\\x09-\\x0D]+`` goes if it lies in a window of ``window`` words whose sequence also starts at another place, in this
    or any other row. A null, empty or shorter text loses nothing. Rows with one word sequence, repeated rows among them, are each
    other's repeats and lose everything they have windows for. A null id stays null. An empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col).withColumn("key", F.xxhash64("text"))  # equal texts have one key and one outcome
    made = staged(parsed(rows.select("doc_id", "key", "text"), window))
    ranges = made.where(F.col("sign").isNotNull()).select("doc_id", "key", "sign", "stretch", "first", "last")
    # Occurrences combine map-side: a passage in a third of all texts is one row for each task here.
    signs = staged(ranges.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("sign"))
    shared = staged(ranges.join(signs, "sign"))
    stretches = staged(
        shared.groupBy("sign", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "doc_id", "first", "last")).alias("one"))
    )
    sure = shared.join(stretches.where(F.col("n") > 1).select("sign", "stretch"), ["sign", "stretch"], "left_semi").select("key", "first", "last")
    # Where the stretches of a sign differ, one that is known to repeat shows its windows once for the others; one of its own is asked about.
    differ = stretches.groupBy("sign").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1).select("sign")
    shown = stretches.join(differ, "sign", "left_semi").select("one.*", (F.col("n") == 1).alias("ask"))
    shown = shown.groupBy("key", "doc_id").agg(F.collect_set(F.struct("first", "last", "ask")).alias("spans"))  # bounded by the text
    shown = staged(shown.withColumnRenamed("doc_id", "one_id"))

    def windows(cols):
        out = {x: [] for x in ("w1", "w2", "key", "at", "ask")}
        for key, text, own in zip(cols["key"], cols["text"], cols["spans"], strict=True):
            h = word_hashes(words_of(text))
            spread = [np.arange(x["first"], x["last"] + 1) for x in own]
            at = np.concatenate(spread)
            for which, name in enumerate(("w1", "w2")):  # one set of running sums for all spans of a text
                out[name].append(stretch_hashes(h, at, at + window, which).view(np.int64))
            out["at"].append(at), out["key"].append(np.full(len(at), key))
            out["ask"].append(np.repeat([x["ask"] for x in own], [len(x) for x in spread]))
        return {x: np.concatenate(v) for x, v in out.items()}

    one = rows.join(shown, (rows["key"] == shown["key"]) & rows["doc_id"].eqNullSafe(shown["one_id"])).select(rows["key"], "text", "spans")
    listed = staged(arrow_map(one, windows, "w1 long, w2 long, key long, at int, ask boolean"))
    again = listed.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("ask")).where((F.col("n") > 1) & F.col("ask")).select("w1", "w2")
    hits = listed.where("ask").join(again, ["w1", "w2"], "left_semi").select("key", F.col("at").alias("first"), F.col("at").alias("last"))
    spans = sure.transform(stacked, hits).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))  # bounded by the text
    spans = staged(spans)

    def removed(cols):
        out = {x: [] for x in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
        for doc_id, text, own in zip(cols["doc_id"], cols["text"], cols["spans"], strict=True):
            words = words_of(text)
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, [s["first"] for s in own], 1)
            np.add.at(edge, [s["last"] + window for s in own], -1)
            keep = np.cumsum(edge[:-1]) == 0
            left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            row = (doc_id, len(words), len(words) - len(left), kept_digest(left), b" ".join(left).decode())
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = arrow_map(rows.join(spans, "key").select("doc_id", "text", "spans"), removed, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    base = made.where(F.col("sign").isNull()).join(spans.select("key"), "key", "left_anti")
    base = base.select("doc_id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return base.transform(stacked, cut)
