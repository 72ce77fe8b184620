"""Collocations from counts of phrases, by vertical partitioning of the suffixes of all pieces.

1. Vertical partitioning. Prefixes (of one word at first) are counted over all texts. A prefix that occurs more often than the memory
   budget of a subtree is replaced by its extensions by one word, counted in the next round; the others are stems. Prefixes over the
   budget are few whatever the input: the budget is at least ``1 / HEAVY`` of all words.
2. Subtrees. Every suffix, cut after four words, goes to the group of its stem; groups hold half a budget on average. A group's suffixes,
   its leaves, are sorted; nodes of the subtree are runs of equal beginnings, and a node's count is the total of the leaves below it.
   Groups share nothing and a task holds one at a time.
3. Counts of at least 30 are all that scores need: parts of a frequent phrase are as frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelstone.llm.common import mix, pick, staged
from panelstone.session import stacked

# Words of the longest phrase: the depth of the subtrees.
DEPTH = 4
# Suffixes of one stem at least allowed, and the most prefixes of one length that can be over the budget.
BUDGET, HEAVY = 1 << 19, 1 << 20
# Characters of text whose equal suffixes are combined before they leave the task, and those that wait in all languages.
SLICE_CHARS, WAITING_CHARS = 2_000_000, 5_000_000
# Score of a cut, in decimals as the product may pass 64 bits.
SCORE = "cast(2000000 as decimal(8,0)) * cast(a as decimal(24,0)) div (cast(l as decimal(24,0)) + cast(r as decimal(24,0)))"

_CUT = 0xFF  # no byte of UTF-8: stands for the end of a piece
_FOLD = bytes(c + 32 if 65 <= c <= 90 else _CUT if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
_EDGE = bytes([_CUT])


def packed(columns: list[np.ndarray], base: int) -> np.ndarray:
    """One number for each row of columns of numbers below ``base``, equal for equal rows and in their order."""
    code, span = columns[0], base
    for c in columns[1:]:
        if span * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            span = len(code) + 1
        code, span = code * base + c, span * base
    return code


def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct number, and how many there are of it."""
    order = np.argsort(code)
    ranked = code[order]
    heads = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] - 1))
    return order[heads], np.diff(heads, append=len(code))


class Suffixes:
    """Words of some texts of one language as numbers, and for each word the numbers of the words after it in its piece.

    ``after[k]`` holds the k-th word from each place, 0 beyond the end of the piece; ``words[i]`` is the word of number i.
    """

    def __init__(self, texts: list[str]):
        blob = _EDGE.join(t.encode().translate(_FOLD) for t in texts).replace(_EDGE, b" \xff ")
        numbers = _Numbers()
        numbers[_EDGE]  # number 0
        codes = np.array([numbers[w] for w in blob.split()], dtype=np.int64)
        self.numbers, self.words, self.size = numbers, list(numbers), len(numbers)
        after = [codes]
        for k in range(1, DEPTH):
            moved = np.zeros_like(codes)
            moved[:-k] = codes[k:]
            after.append(np.where(after[-1] > 0, moved, 0))
        places = np.flatnonzero(codes)
        self.after = [a[places] for a in after]

    def prefixes(self, length: int, among: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Distinct prefixes of that many words at the places ``among`` (all must have them), joined by a space, and their counts."""
        columns = [self.after[k][among] for k in range(length)]
        first, counts = distinct(packed(columns, self.size))
        return [b" ".join([self.words[i] for i in row]) for row in zip(*(c[first].tolist() for c in columns))], counts

    def heavy(self, prefixes: set[bytes], length: int, among: np.ndarray) -> np.ndarray:
        """Which of the places ``among`` begin with one of ``prefixes`` of that length."""
        wanted = [p for p in (tuple(self.numbers.get(w, 0) for w in x.split(b" ")) for x in prefixes) if min(p) > 0]
        if not wanted or not len(among):
            return np.zeros(len(among), dtype=bool)
        # One numbering for both.
        code = packed([np.concatenate([self.after[k][among], np.array([p[k] for p in wanted])]) for k in range(length)], self.size)
        return np.isin(code[: len(among)], code[len(among) :])


class _Numbers(dict):
    """Numbers of words in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Suffixes]]:
    """Texts of a task, by language, some megabytes at a time."""
    waiting: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            lang, text = lang.as_py(), text.as_py()
            if text:
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] > SLICE_CHARS:
                    yield lang, Suffixes(waiting.pop(lang))
                    sizes[lang] = 0
        if sum(sizes.values()) > WAITING_CHARS:
            for lang in list(waiting):
                yield lang, Suffixes(waiting.pop(lang))
            sizes.clear()
    for lang in list(waiting):
        yield lang, Suffixes(waiting.pop(lang))


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(language, suffixes)`` gives columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, suffixes in _by_language(batches):
            columns = fn(lang, suffixes)
            if len(columns[-1]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([[lang] * len(columns[-1]), *columns], arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


Heavy = list[dict[str, set[bytes]]]


def _under_heavy(lang: str, suffixes: Suffixes, heavy: Heavy, length: int) -> np.ndarray:
    """Places whose first ``length`` words, and all beginnings of them, are over the budget."""
    among = np.arange(len(suffixes.after[0]))
    for k in range(length):
        among = among[suffixes.heavy(heavy[k].get(lang, set()), k + 1, among)]
    return among


def prefix_counts(rows: DataFrame, heavy: Heavy) -> DataFrame:
    """``lang, phrase, f``: one word more than the longest of ``heavy``, at the places that these begin."""
    length = len(heavy)

    def work(lang: str, suffixes: Suffixes) -> tuple:
        if not length:
            return suffixes.words[1:], np.bincount(suffixes.after[0], minlength=suffixes.size)[1:]
        among = _under_heavy(lang, suffixes, heavy, length)
        among = among[suffixes.after[length][among] > 0]
        return suffixes.prefixes(length + 1, among) if len(among) else ([], [])

    return _map(rows, work, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as all of them need."""
    top = int(numbers.max())
    return numbers.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``narrow``."""
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


def suffix_blocks(rows: DataFrame, heavy: Heavy, groups: int) -> DataFrame:
    """``lang, grp, words, codes, stems, counts``: the suffixes of some megabytes of text that belong to one group, equal ones combined.

    ``codes`` are four numbers for each suffix, positions from 1 in ``words`` (parted by line feeds, which no word holds) or 0; ``stems``
    are the words of its stem. A suffix that is no longer than its stem is counted with the prefixes already.
    """

    def work(lang: str, suffixes: Suffixes) -> tuple:
        after, among, made = suffixes.after, np.arange(len(suffixes.after[0])), []
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, suffixes.words), dtype=np.uint64, count=suffixes.size)
        key = np.zeros(len(among), dtype=np.uint64)
        for k in range(DEPTH - 1):
            # Places whose first k words are over the budget; the stem has one word more unless that is over it too.
            among = among[after[k][among] > 0]
            key[among] = mix(key[among] * np.uint64(0x9E3779B97F4A7C15) + names[after[k][among]])
            over = suffixes.heavy(heavy[k].get(lang, set()) if k < len(heavy) else set(), k + 1, among)
            own, among = among[~over], among[over]
            own = own[after[k + 1][own] > 0]
            if len(own):
                first, counts = distinct(packed([a[own] for a in after], suffixes.size))
                at = own[first]
                made.append((key[at] % np.uint64(groups), np.full(len(at), k + 1), np.stack([a[at] for a in after], axis=1), counts))
        if not made:
            return [], [], [], [], []
        group, stem, codes, counts = (np.concatenate(x) for x in zip(*made))
        order = np.argsort(group)
        group, stem, codes, counts = group[order], stem[order].astype("u1"), codes[order], counts[order]
        heads = np.flatnonzero(np.diff(group, prepend=group[:1] + np.uint64(1)))
        out: tuple[list, ...] = ([], [], [], [], [])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(group)]):
            used, local = np.unique(np.append(codes[a:b], 0), return_inverse=True)  # 0 is always among them, and first
            words = b"\n".join([suffixes.words[i] for i in used[1:].tolist()])
            for column, value in zip(out, (int(group[a]), words, narrow(local[:-1]), stem[a:b].tobytes(), narrow(counts[a:b]))):
                column.append(value)
        return out

    return _map(rows, work, "lang string, grp long, words binary, codes binary, stems binary, counts binary")


def subtree(blocks: list[tuple[bytes, bytes, bytes, bytes]], least: int) -> tuple[list[bytes], list[int]]:
    """Nodes below the stems that hold at least ``least``, from the sorted leaves of one group: phrases and counts."""
    numbers = _Numbers()
    numbers[b"\n"]  # number 0: no word
    parts = []
    for words, codes, stem, _ in blocks:
        local = np.array([0, *[numbers[w] for w in words.split(b"\n")]], dtype=np.int64)
        parts.append(local[wide(codes, DEPTH * len(stem))].reshape(-1, DEPTH))
    leaves = np.concatenate(parts)
    stems = np.concatenate([np.frombuffer(x[2], "u1") for x in blocks])
    counts = np.concatenate([wide(x[3], len(x[2])) for x in blocks])
    order = np.argsort(packed(list(leaves.T), len(numbers)))
    leaves, stems, counts = leaves[order], stems[order], counts[order]
    words, phrases, totals = list(numbers), [], []
    new = np.ones(len(leaves), dtype=bool)
    new[1:] = leaves[1:, 0] != leaves[:-1, 0]
    for depth in range(2, DEPTH + 1):
        new[1:] |= leaves[1:, depth - 1] != leaves[:-1, depth - 1]
        heads = np.flatnonzero(new)
        sums = np.add.reduceat(counts, heads)
        kept = np.flatnonzero((sums >= least) & (leaves[heads, depth - 1] > 0) & (stems[heads] < depth))
        phrases += [b" ".join([words[i] for i in row]) for row in leaves[heads[kept], :depth].tolist()]
        totals += sums[kept].tolist()
    return phrases, totals


def subtree_counts(blocks: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f`` of all groups. A task holds one group at a time, which the budget bounds."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64())])

    def build(key: tuple, group: pa.Table) -> pa.Table:
        phrases, totals = subtree(list(zip(*(group.column(x).to_pylist() for x in ("words", "codes", "stems", "counts")))), least)
        return pa.table([pa.array([key[1].as_py()] * len(totals), pa.string()), pa.array(phrases, pa.binary()), pa.array(totals, pa.int64())], schema=schema)

    return blocks.groupBy("grp", "lang").applyInArrow(build, "lang string, phrase binary, f long")


def phrase_counts(docs: DataFrame, *, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All phrases of up to four words that occur at least ``least`` times (``lang, phrase, f``), and each language's words (``lang, n``)."""
    rows = pick(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words = staged(prefix_counts(rows, []))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    budget = max(BUDGET, -(-total // HEAVY))
    level, heavy = words, []
    counts = words.where(F.col("f") >= least)
    while len(heavy) < DEPTH:
        # At most total / budget <= HEAVY prefixes of one length can be over the budget.
        over = level.where(F.col("f") > budget).select("lang", "phrase").collect()
        if not over or len(heavy) == DEPTH - 1:
            break
        heavy.append({})
        for lang, phrase in over:
            heavy[-1].setdefault(lang, set()).add(bytes(phrase))
        level = staged(prefix_counts(rows, heavy))
        counts = stacked(counts, level.where(F.col("f") >= least))
    groups = max(1, -(-2 * total // budget))
    nodes = subtree_counts(suffix_blocks(rows, heavy, groups), least)
    return staged(stacked(counts, nodes).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")), totals


def collocations(
    docs: DataFrame, *, least: int = 30, most: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``most`` phrases of 2 to 4 words.

    A phrase that occurs ``least`` times is scored by its weakest cut, floor(2000000 a / (l + r)); it is dropped if it stands inside a
    longer such phrase that has 80 % of its occurrences. Products are taken in decimals of 38 digits, so they are exact beyond 64 bits.
    A null language is ``und``, a null or empty text holds nothing, repeated rows count as often as they stand there, phrases of equal
    score go by count and then by their bytes; an empty table gives no row. Texts and pieces of any length are taken whole.
    """
    counts, totals = phrase_counts(docs, least=least, lang_col=lang_col, text_col=text_col)
    words = F.split("phrase", " ")
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("w")).where(F.size("w") > 1)
    wide = lambda c: F.col(c).cast("decimal(24,0)")

    # Longer phrases tell the phrases inside them how often they occur; the largest such count decides.
    inside = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    held = candidates.where(F.size("w") > 2).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("a").alias("longer"))
    held = held.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < 80 * wide("a")))

    cut = F.expr("explode(transform(sequence(1, size(w) - 1), k -> named_struct('k', k, 'head', array_join(slice(w, 1, k), ' '), 'tail', array_join(slice(w, k + 1, size(w)), ' '))))")
    cuts = kept.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr(SCORE))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
