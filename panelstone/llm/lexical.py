"""Ranked lexical search by NRA: sorted reads only, score intervals per document, no random access.

A term's contribution to a document depends on neither the item nor its other terms, so one index serves all items: for each document the
item terms it holds, with their counts, written once. Documents are searched in blocks. In a block every term has a list sorted by
contribution; an item reads its lists from the top, a stripe at a time, all in step. A document's lower bound is what has been read of
it, its upper bound adds, for each of the item's lists in which it has not been met, the contribution at which that list now stands. A
document whose upper bound is below the k-th best lower bound (of this task, blocks before included) is out. Reading ends when every
document still in has equal bounds: then membership, order, ties and scores are final.

Blocks share nothing but the k-th best score of their task, which only saves reads; the k best of all tasks are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelstone.llm.common import arrow_map, pick, staged
from panelstone.session import stacked

# Rows of item terms that one search carries to the tasks; items beyond it are searched by further ones, in blocks of items.
ITEM_TERM_ROWS = 200_000
# Documents in a block, and cells of documents times terms of the longest item: the memory of one item's intervals.
BLOCK_DOCS, BLOCK_CELLS = 8192, 4_000_000
# Entries of a list read at first; every further stripe is twice as long.
STRIPE = 64

# Everything that is no letter, digit or byte of a longer code point parts terms; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other code points from U+0080, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


@lru_cache(maxsize=2)
def _numbered(terms: tuple[bytes, ...]) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(terms)}


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct ``item, term``; rows of one id are one item."""

    def work(cols: dict) -> dict:
        ids, terms = [], []
        for i, text in zip(cols["item"], cols["text"]):
            if i is not None:
                own = sorted(set(terms_of(text)))
                ids += [i] * len(own)
                terms += own
        return {"item": ids, "term": terms}

    rows = pick(items, item=item_col, text=text_col).select(F.col("item").cast("long"), "text")
    return arrow_map(rows, work, "item long, term binary").distinct()


def term_index(docs: DataFrame, terms: tuple[bytes, ...]) -> DataFrame:
    """``doc, n, terms, tfs`` for every document that holds any term: its length, and which of ``terms`` it holds how often."""

    def work(cols: dict) -> dict:
        number = _numbered(terms)
        out: dict[str, list] = {"doc": [], "n": [], "terms": [], "tfs": []}
        for doc, text in zip(cols["doc"], cols["text"]):
            words = terms_of(text)
            if words:
                met, counts = np.unique(np.fromiter((number.get(w, -1) for w in words), dtype=np.int32, count=len(words)), return_counts=True)
                skip = int(met[0] < 0)
                for name, value in (("doc", doc), ("n", len(words)), ("terms", met[skip:]), ("tfs", counts[skip:])):
                    out[name].append(value)
        return out

    return arrow_map(docs, work, "doc long, n long, terms array<int>, tfs array<long>")


class Searcher:
    """NRA over blocks of documents, one item after the other; keeps each item's k best."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray, k: int):
        self.items, self.weights, self.k = items, weights, k
        self.best: dict[int, list[tuple[int, bool, int]]] = {item: [] for item, _ in items}

    def block(self, docs: list, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> None:
        """Sort the block's lists and search them. ``ends`` are the ends of each document's part of ``terms`` and ``tfs``."""
        own = np.repeat(np.arange(len(docs)), np.diff(ends, prepend=0))
        gains = self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[own]))
        order = np.lexsort((-gains, terms))
        own, gains, terms = own[order], gains[order], terms[order]
        heads = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        for item, wanted in self.items:
            lists = [(heads[t], heads[t + 1]) for t in wanted if heads[t] < heads[t + 1]]
            if lists:
                held = self.best[item]
                floor = held[self.k - 1][0] if len(held) >= self.k else 0
                for i, score in self._read(lists, own, gains, len(docs), floor):
                    held.append((score, docs[i] is None, docs[i] or 0))
                held.sort(key=lambda x: (-x[0], x[1], x[2]))
                del held[self.k :]

    def _read(self, lists: list[tuple[int, int]], own: np.ndarray, gains: np.ndarray, n: int, floor: int) -> list[tuple[int, int]]:
        """Documents that may be among the k best, with their final scores. Bounds of all documents, met or not, are held as arrays."""
        at = np.array([a for a, _ in lists])
        end = np.array([b for _, b in lists])
        stands = gains[at]  # what the next entry of each list gives at most
        lower = np.zeros(n, dtype=np.int64)
        unmet = np.ones((n, len(lists)), dtype=bool)
        live = np.arange(n)
        stripe = STRIPE
        while True:
            missing = unmet[live]
            upper = lower[live] + np.where(missing, stands, 0).sum(axis=1)
            if n > self.k:
                floor = max(floor, int(np.partition(lower, n - self.k)[n - self.k]))
            stays = upper >= max(floor, 1)
            live, missing = live[stays], missing[stays]
            open_lists = np.flatnonzero((stands > 0) & missing.any(axis=0))
            if not len(open_lists):
                return [(int(i), int(lower[i])) for i in live]
            for j in open_lists:
                a, b = at[j], min(at[j] + stripe, end[j])
                met = own[a:b]
                lower[met] += gains[a:b]
                unmet[met, j] = False
                at[j] = b
                stands[j] = gains[b] if b < end[j] else 0
            stripe *= 2


def _search(index: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item, doc, score``: the k best of every task for every item."""
    size = max(1, min(BLOCK_DOCS, BLOCK_CELLS // max([1, *(len(w) for _, w in items)])))
    schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, waiting, rows = Searcher(items, weights, k), [], 0

        def flush() -> None:
            t = pa.Table.from_batches(waiting).combine_chunks()
            lengths = t.column("n").to_numpy()
            m = 10 + (90 * lengths * n_docs) // n_terms
            lists = t.column("terms").combine_chunks()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            tfs = t.column("tfs").combine_chunks().flatten().to_numpy()
            searcher.block(t.column("doc").to_pylist(), lengths, ends, lists.flatten().to_numpy(), tfs, m)

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                if rows + part.num_rows > size:
                    flush()
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if waiting:
            flush()
        found = [(item, None if none else doc, score) for item, held in searcher.best.items() for score, none, doc in held]
        yield pa.RecordBatch.from_pylist([{"item": i, "doc": d, "score": s} for i, d, s in found], schema=schema)

    return index.mapInArrow(run, "item long, doc long, score long")


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest score above 0 for each item, equal scores by ascending id.

    Scores are those of the contract: integer weights by document frequency, saturated counts, lengths against the mean. A null text has
    no term and counts neither as a document nor in the mean; rows without an id take part and come last among equal scores; every row
    of a repeated id is a document. Rows of one item id are one item, rows without one and items without a term found give no row. Empty
    tables give none. What is carried to tasks is bounded by ``ITEM_TERM_ROWS``; more items are searched block by block, and an item
    with more terms than that makes its block larger.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc=id_col, text=text_col).select(F.col("doc").cast("long"), "text")
    wanted = staged(item_terms(items, item_col, item_text_col))
    blocks = -(-wanted.count() // ITEM_TERM_ROWS)
    found = spark.range(0).select(F.col("id").alias("item"), F.col("id").alias("doc"), F.col("id").alias("score"))
    for b in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").toArrow()
        if own.num_rows:
            found = stacked(found, _search_items(rows, own, k))
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _search_items(rows: DataFrame, own: pa.Table, k: int) -> DataFrame:
    """One block of items: index, statistics, search."""
    names = own.column("term").to_pylist()
    terms = tuple(sorted(set(names)))
    number = _numbered(terms)
    ids = own.column("item").to_numpy()
    numbers = np.fromiter((number[t] for t in names), dtype=np.int64, count=len(names))
    cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    items = [(int(ids[a]), numbers[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)])]

    index = staged(term_index(rows, terms))
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(terms), dtype=np.int64)
    df[counted.column("t").to_numpy()] = counted.column("df").to_numpy()
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    return _search(index, items, weights, n_docs, n_terms, k)
