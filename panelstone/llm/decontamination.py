"""Benchmark passages in documents, by SimHash of item-sized windows. DataFrame functions only.

Texts are lower-cased words; features are five-word shingles, weighted by how often they occur in the window.

1. A window without any shingle of an item has similarity 0 to it, so fingerprints are only needed around shared shingles. Positions
   whose shingle occurs in an item are found by one join; runs of them become islands that hold every window with at least one.
2. Each window of an island, of the size of the item that it met, gets a 64-bit SimHash. Three counters share a long, so 22 sums make
   all 64 bits.
3. Multi-index: the 64 bits are cut into blocks. Two fingerprints within the radius differ in at most ``radius // blocks`` bits of some
   block, so items are listed under all such variants of their blocks and windows look up their own: nothing within is missed.
4. Candidates are verified by the exact weighted Jaccard similarity.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.llm.common import fresh, pick, small_side, staged

WIDTH, PERCENT = 5, 80
BITS, LANES, LANE_BITS = 64, 3, 20
STEPS = -(-BITS // LANES)
# Similarity 0.8 puts about 10 of 64 bits apart (deviation 3); the radius leaves a margin of more than four deviations.
RADIUS, BLOCKS = 23, 8


def words(text: Column) -> Column:
    """Lower-case words, an empty array for a null or empty text."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingles(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """``keep..., p, gram`` for every shingle of the array ``ws``; ``p`` counts from 0."""
    n = F.greatest(F.size("ws") - (width - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice("ws", F.lit(k + 1), n).alias(f"w{k}") for k in range(width)])
    rows = df.where(F.size("ws") >= width).select(*keep, F.posexplode(parts).alias("p", "g"))
    return rows.select(*keep, "p", F.xxhash64(F.lit(width), *[F.col(f"g.w{k}") for k in range(width)]).alias("gram"))


def fingerprint(rows: DataFrame, *by: str) -> DataFrame:
    """SimHash of the bag of ``gram`` in each group: ``by..., grams, print``."""
    bit = lambda i: F.shiftright("gram", i).bitwiseAND(F.lit(1))
    lanes = [[k + STEPS * lane for lane in range(LANES) if k + STEPS * lane < BITS] for k in range(STEPS)]
    packed = [sum((F.shiftleft(bit(i), LANE_BITS * lane) for lane, i in enumerate(own)), F.lit(0).cast("long")) for own in lanes]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("grams"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(packed)])
    # A lane's top bit is set once its count passes half of the bag.
    lift = F.lit((1 << (LANE_BITS - 1)) - 1) - F.floor(F.col("grams") / 2)
    lift = lift * sum(1 << (LANE_BITS * lane) for lane in range(LANES))
    out = F.lit(0).cast("long")
    for k, own in enumerate(lanes):
        high = F.col(f"s{k}") + lift
        for lane, i in enumerate(own):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(high, LANE_BITS * lane + LANE_BITS - 1).bitwiseAND(F.lit(1).cast("long")), i))
    return sums.select(*by, "grams", out.alias("print"))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return list(zip(edges, edges[1:], strict=False))


def block_values(rows: DataFrame, blocks: int, flips: int) -> DataFrame:
    """Add ``block, value``: each block of ``print``, with every choice of up to ``flips`` bits turned. The choices are one literal."""
    cells = [
        F.struct(F.lit(k).alias("block"), F.lit(low).alias("low"), F.lit((1 << (high - low)) - 1).cast("long").alias("ones"), F.lit(sum(1 << b for b in bits)).cast("long").alias("turn"))
        for k, (low, high) in enumerate(block_bounds(blocks)) for n in range(flips + 1) for bits in combinations(range(high - low), n)
    ]
    every = rows.withColumn("b", F.explode(F.array(*cells)))
    value = F.expr("shiftrightunsigned(print, b.low)").bitwiseAND(F.col("b.ones")).bitwiseXOR(F.col("b.turn"))
    return every.select(*rows.columns, F.col("b.block").alias("block"), value.alias("value"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS, blocks: int = BLOCKS,
) -> DataFrame:
    """``doc_id, item_id, similarity, start, size, n_windows``: one row for each document row and item that it holds.

    A document holds an item if a window of as many words as the item (the whole text, if shorter) has a weighted Jaccard similarity of
    ``percent`` / 100 or more on word shingles; ``start`` is the first best window, ``n_windows`` counts all such. An item of fewer words
    than a shingle is one shingle as long as itself. Null or empty texts on either side match nothing. Repeated rows of documents repeat
    their results; items that share an id and a text count once. Null ids are carried like any other. Empty tables give an empty result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    bench = pick(items, item_id=item_col, text=item_text_col).distinct()
    bench = bench.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    bench = staged(bench.select(F.xxhash64("item_id", "ws").alias("item"), "item_id", "ws", F.size("ws").alias("size"), F.least(F.size("ws"), F.lit(width)).alias("width")))
    widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # at most ``width`` values
    found = [_contained(rows, bench.where(F.col("width") == w), w, percent, radius, blocks) for w in widths]
    if not found:
        found = [_contained(rows, bench, width, percent, radius, blocks)]
    held = staged(found[0] if len(found) == 1 else _all(found))
    names = bench.select("item", "item_id")
    hashed = rows.select("doc_id", F.xxhash64("text").alias("key"))
    return hashed.join(small_side(held), "key").join(names, "item").select("doc_id", "item_id", "similarity", "start", "size", "n_windows")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = staged(out).unionByName(staged(x))
    return out


def _contained(rows: DataFrame, bench: DataFrame, width: int, percent: int, radius: int, blocks: int) -> DataFrame:
    grams = staged(shingles(bench, width, "item", "size"))
    listed = grams.select("gram", "size").distinct()
    texts = rows.select(F.xxhash64("text").alias("key"), words(F.col("text")).alias("ws"))
    texts = texts.select("key", F.size("ws").alias("n"), "ws")
    hits = shingles(texts, width, "key", "n").join(small_side(staged(listed)), "gram").select("key", "n", "size", "p").distinct()

    # Starts of windows that hold the hit, merged into islands of neighbouring starts.
    reach = F.col("size") - width
    first = F.greatest(F.least(F.col("p") - reach, F.col("n") - F.col("size")), F.lit(0))
    last = F.greatest(F.least(F.col("p"), F.col("n") - F.col("size")), F.lit(0))
    order = Window.partitionBy("key", "size").orderBy("p")
    marked = hits.select("key", "n", "size", "p", first.alias("first"), last.alias("last"))
    marked = marked.withColumn("new", F.coalesce((F.col("first") > F.lag("last", 1).over(order) + 1).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("new").over(order)).groupBy("key", "n", "size", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    islands = staged(islands.select("key", "size", "first", "last"))

    # The words of each island, and its shingles with the windows that they belong to. Copies of a text are one.
    held = staged(rows.select(F.xxhash64("text").alias("key"), "text").join(small_side(islands.select("key").distinct()), "key").groupBy("key").agg(F.first("text").alias("text")))
    parts = held.select("key", words(F.col("text")).alias("all")).join(islands, "key")
    parts = parts.select("key", "size", "first", "last", F.slice("all", F.col("first") + 1, F.col("last") - F.col("first") + F.col("size")).alias("ws"))
    local = staged(shingles(parts, width, "key", "size", "first", "last").withColumn("p", F.col("p") + F.col("first")))
    begins = F.sequence(F.greatest("first", F.col("p") - (F.col("size") - width)), F.least("last", F.col("p")))
    spread = local.select("key", "size", "gram", F.explode(begins).alias("start"))
    windows = staged(fingerprint(spread, "key", "size", "start"))

    asked = fingerprint(grams, "item", "size")
    index = block_values(asked.select("item", "size", "print", F.col("grams").alias("item_grams")), blocks, radius // blocks).withColumnRenamed("print", "item_print")
    probes = block_values(windows, blocks, 0)
    near = probes.join(
        index,
        (probes["size"] == index["size"]) & (probes["block"] == index["block"]) & (probes["value"] == index["value"])
        & (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        & (F.least("grams", "item_grams") * 100 >= F.greatest("grams", "item_grams") * percent),
    )
    near = staged(near.select("key", probes["size"].alias("size"), "start", "grams", "item", "item_grams").distinct())

    inside = near.join(local.select("key", "size", "p", "gram"), ["key", "size"]).where(F.col("p").between(F.col("start"), F.col("start") + F.col("size") - width))
    bags = inside.groupBy("key", "size", "start", "grams", "item", "item_grams", "gram").agg(F.count(F.lit(1)).alias("there"))
    own = grams.groupBy("item", "gram").agg(F.count(F.lit(1)).alias("here"))
    common = bags.join(own, ["item", "gram"]).groupBy("key", "size", "start", "grams", "item", "item_grams").agg(F.sum(F.least("there", "here")).alias("both"))
    every = F.col("grams") + F.col("item_grams") - F.col("both")
    same = common.where(F.col("both") * 100 >= every * percent).withColumn("similarity", F.col("both") / every)
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("start"))
    out = same.groupBy("key", "item", "size").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n_windows"))
    return out.select("key", "item", F.col("best.similarity").alias("similarity"), (-F.col("best.start")).cast("long").alias("start"), F.col("size").cast("long").alias("size"), "n_windows")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, without the texts that hold an item. A document without an id is judged by its text like any other.

    Null and empty texts stay, as do all rows when no item has a word; repeated rows stay or go together.
    """
    gone_key = fresh(docs, "_gone")
    keyed = docs.select(F.struct(id_col, text_col).alias("_pair"), F.xxhash64(F.col(f"`{text_col}`")).alias("_key"))
    by_key = keyed.select(F.col("_key").alias("doc_id"), F.col(f"_pair.`{text_col}`").alias("text"))
    gone = staged(contamination(by_key, items, "doc_id", "text", **options).select(F.col("doc_id").alias(gone_key)).distinct())
    return docs.join(small_side(gone), F.xxhash64(F.col(f"`{text_col}`")) == F.col(gone_key), "left_anti")
