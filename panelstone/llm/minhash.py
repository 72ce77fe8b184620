"""Near-duplicate documents by circulant MinHash.

A document is the set of its word shingles. One permutation places every shingle on a circle; a second, shifted by one position for
each coordinate, gives all coordinates of the signature. A shingle therefore contributes one contiguous window of a fixed table, and
a signature is the minimum over such windows.

Steps, each over all documents:

1. One pass over the texts: set size, a 128-bit name of the set, one key per band of the signature.
2. Documents with equal sets become one class. Classes that share a band key meet there at one head, the class with most company: a
   star, not all pairs.
3. Every candidate link is confirmed by the exact Jaccard similarity of the full sets.
4. Components of the confirmed links. A star whose members are in several components may hide links between members. Two members can
   only be linked past their head if they differ from it in the same shingles, and in how many follows from the sizes. So members
   are matched on those differences with a prefix filter, which loses no link, and what matches is confirmed like any other pair.

Two sets at the threshold of 0.8 share none of 40 bands of 5 coordinates with probability 0.672^40, about 1e-7.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstone.llm.common import arrow_map, fresh, mix, pick, shingle_hashes, small_side, staged
from panelstone.llm.components import components
from panelstone.session import stacked

CIRCLE_BITS = 20
BANDS, BAND_ROWS = 40, 5
# Shingles whose windows are gathered at a time (bounds a worker's memory).
GATHER = 2048
# Longest sketch of a member's differences, in words of 64 bits (shorter sets have shorter ones).
SKETCH_WORDS = 16


@lru_cache(maxsize=2)
def circle(coordinates: int) -> np.ndarray:
    """Windows of the second permutation: row ``p`` holds its values at ``p, p + 1, ...`` around the circle."""
    size = 1 << CIRCLE_BITS
    order = np.random.Generator(np.random.PCG64(20240229)).permutation(size).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of one set (not empty)."""
    # First permutation: a 64-bit bijection, of which the leading bits are the place on the circle.
    place = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    windows, out = circle(coordinates), None
    for at in range(0, len(place), GATHER):
        low = windows[place[at : at + GATHER]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cells = sig.reshape(bands, rows).astype(np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(31) + cells[:, k])
    return key.view(np.int64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of a text with A-Z in lower case (``bytes.lower`` touches no other letter)."""
    return shingle_hashes(text.encode().lower().split(), width) if text else np.empty(0, dtype=np.uint64)


def signatures(rows: DataFrame, width: int, bands: int, band_rows: int) -> DataFrame:
    """``doc_id, n, c1, c2, keys`` for each row; class and keys are null for an empty set."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(cols):
        n, c1, c2, keys = [], [], [], []
        for text in cols["text"]:
            own = shingle_set(text, width)
            n.append(len(own))
            if not len(own):
                c1.append(None), c2.append(None), keys.append(None)
                continue
            name = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64)
            c1.append(int(name[0])), c2.append(int(name[1]))
            keys.append(band_keys(signature(own, bands * band_rows), bands, band_rows))
        return {"doc_id": cols["doc_id"], "n": n, "c1": c1, "c2": c2, "keys": keys}

    return arrow_map(rows, work, f"doc_id {kind}, n long, c1 long, c2 long, keys array<long>")


def could_link(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sets whose sizes differ too much cannot be similar enough."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with both texts. ``texts``: ``c1, text`` of every class named."""
    right = pairs.join(texts.select(F.col("c1").alias("b"), F.col("text").alias("text_b")), "b")
    return right.join(texts.select(F.col("c1").alias("a"), F.col("text").alias("text_a")), "a").select(*pairs.columns, "text_a", "text_b")


class Sets:
    """Shingle sets of one column of texts; the last one is kept, as a star's rows come together."""

    def __init__(self, width: int):
        self.width, self.last, self.own = width, None, None

    def of(self, name: int, text: str) -> np.ndarray:
        if name != self.last:
            self.last, self.own = name, shingle_set(text, self.width)
        return self.own


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of the candidate ``a, b``, those whose full sets are similar enough."""

    def work(cols):
        a, b, heads = [], [], Sets(width)
        for x, y, text_a, text_b in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"], strict=True):
            own, other = heads.of(x, text_a), shingle_set(text_b, width)
            common = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * common >= percent * (len(own) + len(other) - common):
                a.append(x), b.append(y)
        return {"a": a, "b": b}

    return arrow_map(beside(pairs.select("a", "b"), texts), work, "a long, b long", rows=64)


def sketch(signs: np.ndarray, words: int) -> np.ndarray:
    """Parity of the signs at each of ``64 * words`` places. Every sign that only one of two sets has turns at most one place, so two
    sketches never differ in more places than the sets differ in signs.
    """
    place = (mix(signs.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * words)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def hidden_pairs(stars: DataFrame, found: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of members of one star (its head included), in different components, that may still be linked.

    Measured from any set C, |X ^ M| = dX + dM - 2 * o, where dX, dM count the members' differences from C and o those they have in
    common. A link means |X ^ M| <= k * (|X| + |M|), k = (100 - percent) / (100 + percent), so with sX = dX - k * |X| it means
    o >= (sX + sM) / 2. C is what most of a few dozen members contain; H is the member of least s.

    * Every member is compared with H. That covers all pairs with sX + sM <= 0.
    * Otherwise one of a pair, X, is not linked to H, so sX > -sH and o > (sM - sH) / 2; and o >= (sX + sH) / 2, as H has the least s.
      In one order of all signs (what C lacks first, being rare), the first common one has o - 1 more behind it on either side. So it
      is among the first dM - floor((sM - sH) / 2) of M and the first dX - ceil((sX + sH) / 2) + 1 of X, and a match counts only if
      what is left from there on, on both sides, leaves room for o >= (sX + sM) / 2.
    * |X ^ M| is at least the number of places in which their sketches differ: a pair that differs there in more than
      k * (|X| + |M|) is no link and is never formed.
    """
    part = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}"))
    member = stars.join(part("b"), "b", "left").select("a", "b", F.coalesce("in_b", "b").alias("part"))
    heads = stars.select("a").distinct().join(part("a"), "a", "left").select("a", F.col("a").alias("b"), F.coalesce("in_a", "a").alias("part"))
    member = staged(member.transform(stacked, heads))
    several = member.groupBy("a").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("size"))
    rows = beside(member.join(several.where((F.col("low") < F.col("high")) & (F.col("size") > 2)).select("a", "size"), "a"), texts)

    def differences(cols):
        out = {x: [] for x in ("a", "b", "part", "size", "n", "added", "lost")}
        sets = Sets(width)
        for a, b, group, size, text_a, text_b in zip(*[cols[x] for x in ("a", "b", "part", "size", "text_a", "text_b")], strict=True):
            own, other = sets.of(a, text_a), shingle_set(text_b, width)
            added, lost = np.setdiff1d(other, own, assume_unique=True), np.setdiff1d(own, other, assume_unique=True)
            for name, value in zip(out, (a, b, group, size, len(other), added.view(np.int64), lost.view(np.int64)), strict=True):
                out[name].append(value)
        return out

    told = staged(arrow_map(rows, differences, "a long, b long, part long, size long, n long, added array<long>, lost array<long>", rows=64))
    # Any C is right; a good one keeps the next step small. A star's sample is bounded, whatever its size.
    few = told.where(F.pmod(F.xxhash64("b"), F.col("size")) < 48)
    votes = few.groupBy("a").agg(F.count(F.lit(1)).alias("votes"))
    turned = votes
    for column in ("added", "lost"):
        counts = few.select("a", F.explode(column).alias("sign")).groupBy("a", "sign").count().join(votes, "a").where(F.col("count") * 2 > F.col("votes"))
        turned = turned.join(counts.groupBy("a").agg(F.collect_list("sign").alias(f"turned_{column}")), "a", "left")

    def recentred(cols):
        out = {x: [] for x in ("a", "id", "part", "n", "s", "plus", "gone", "bits")}
        ints = lambda x: np.array(x if x is not None else [], dtype=np.int64)
        for a, b, group, n, added, lost, now_in, now_out in zip(
            *[cols[x] for x in ("a", "b", "part", "n", "added", "lost", "turned_added", "turned_lost")], strict=True
        ):
            added, lost, now_in, now_out = ints(added), ints(lost), ints(now_in), ints(now_out)
            plus = np.concatenate([np.setdiff1d(added, now_in), np.setdiff1d(now_out, lost)])
            gone = np.concatenate([np.setdiff1d(lost, now_out), np.setdiff1d(now_in, added)])
            s = (len(plus) + len(gone)) * (100 + percent) - (100 - percent) * n
            words = min(SKETCH_WORDS, 1 + (n - len(added) + len(lost)) // 32)  # by the set of the star's head: one length in a star
            bits = sketch(np.concatenate([plus, gone]), words)
            for name, value in zip(out, (a, b, group, n, s, plus, gone, bits), strict=True):
                out[name].append(value)
        return out

    schema = "a long, id long, part long, n long, s long, plus array<long>, gone array<long>, bits array<long>"
    drawn = staged(arrow_map(told.join(turned, "a", "left"), recentred, schema))
    heads = drawn.groupBy("a").agg(F.min(F.struct("s", "id", "part", "n")).alias("h"))
    drawn = drawn.join(heads, "a")
    apart = F.col("part") != F.col("h.part")
    near_head = drawn.where(apart & could_link(F.col("n"), F.col("h.n"), percent)).select(F.col("h.id").alias("x"), F.col("id").alias("m"))

    every = F.concat(F.array_sort("plus"), F.array_sort("gone"))
    unit = 2 * (100 + percent)
    some_m = F.size(every) - F.floor((F.col("s") - F.col("h.s")) / unit).cast("int")
    some_x = F.size(every) - F.ceil((F.col("s") + F.col("h.s")) / unit).cast("int") + 1

    def prefix(rows, some, x):
        signs = F.posexplode(F.slice(every, F.lit(1), F.greatest(some, F.lit(0)))).alias(f"place_{x}", f"sign_{x}")
        return rows.select(F.col("a").alias(f"a_{x}"), signs, *[F.col(c).alias(f"{c}_{x}") for c in ("id", "part", "n", "s", "bits")], F.size(every).alias(f"d_{x}"))

    # What a pair can have in common from its first common sign on.
    left = F.least(F.col("d_x") - F.col("place_x"), F.col("d_m") - F.col("place_m"))
    differ = F.aggregate(F.zip_with("bits_x", "bits_m", lambda x, m: F.bit_count(x.bitwiseXOR(m))), F.lit(0), lambda low, d: low + d)
    met = prefix(drawn.where(apart), some_x, "x").join(
        prefix(drawn, some_m, "m"),
        (F.col("a_x") == F.col("a_m")) & (F.col("sign_x") == F.col("sign_m")) & (F.col("part_x") != F.col("part_m"))
        & could_link(F.col("n_x"), F.col("n_m"), percent) & (F.col("s_x") + F.col("s_m") <= left * unit)
        & (differ * (100 + percent) <= (F.col("n_x") + F.col("n_m")) * (100 - percent)),
    )
    pairs = met.select(F.col("id_x").alias("x"), F.col("id_m").alias("m")).transform(stacked, near_head)
    return pairs.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Rows are linked when ``100 * |A & B| >= percent * |A | B|`` on their shingle sets. ``component_id`` is the least id reachable over
    links, the row's own included; ``kept`` tells whether that is the row's own id. A null or empty text, or one of white space, has
    an empty set and is linked with nothing. Repeated rows are equal sets and so one component, and each gets its result row. A null
    id takes part but names no component: a component without any id has a null one, and its rows are not kept unless their set is
    empty. An empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    made = staged(signatures(rows, width, bands, band_rows))
    full = made.where(F.col("c1").isNotNull())
    # Copies combine map-side, so a class of any size is one row here.
    classes = staged(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("keys").alias("keys")))

    cells = classes.select("c1", "n", F.explode("keys").alias("key"))
    met = cells.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    meetings = staged(cells.join(met, "key"))
    company = meetings.groupBy("c1").agg(F.sum("size").alias("company"))
    placed = staged(meetings.join(company, "c1"))
    heads = placed.groupBy("key").agg(F.max(F.struct("company", "c1", "n")).alias("head"))
    stars = placed.join(heads, "key").where(F.col("c1") != F.col("head.c1")).groupBy(F.col("head.c1").alias("a"), F.col("c1").alias("b"))
    stars = staged(stars.agg(F.max("size").alias("size"), F.max("head.n").alias("n_a"), F.max("n").alias("n_b")))
    tried = stars.where(could_link(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")

    named = classes.select("c1", "doc_id")
    wanted = staged(meetings.select("c1").distinct().join(named, "c1"))
    if ids_name_rows(full):
        texts = staged(rows.join(small_side(wanted), "doc_id").select("c1", "text"))
    else:
        texts = staged(class_texts(rows, width).join(small_side(wanted), "c1").groupBy("c1").agg(F.first("text").alias("text")))
    links = staged(confirm(tried, texts, width, percent))
    found = staged(components(links))

    hidden = hidden_pairs(stars.where(F.col("size") > 2).select("a", "b"), found, texts, width, percent)
    more = staged(confirm(hidden.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), texts, width, percent))
    if not more.isEmpty():
        found = staged(components(links.transform(stacked, more)))

    grouped = named.join(found.withColumnRenamed("node", "c1"), "c1", "left").withColumn("component", F.coalesce("component", "c1"))
    ids = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = grouped.join(ids, "component").select("c1", "component_id")
    out = made.join(by_class, "c1", "left")
    component = F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.when(F.col("c1").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )


def ids_name_rows(full: DataFrame) -> bool:
    """Does every row have an id of its own? Then an id finds the text of a class; otherwise the text must be named again."""
    return full.groupBy("doc_id").count().where((F.col("count") > 1) | F.col("doc_id").isNull()).isEmpty()


def class_texts(rows: DataFrame, width: int) -> DataFrame:
    def work(cols):
        sets = [shingle_set(t, width) for t in cols["text"]]
        names = [int(np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), dtype=np.int64)[0]) if len(x) else None for x in sets]
        return {"c1": names, "text": cols["text"]}

    return arrow_map(rows.select("text"), work, "c1 long, text string").where(F.col("c1").isNotNull())


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, all columns, without those that a smaller id of their component stands for.

    Of rows that share an id and a text, one stays. A row without an id stays.
    """
    gone_id, twice_id = fresh(df, "_gone"), fresh(df, "_twice")
    judged = staged(near_duplicates(df, id_col, text_col, width, percent))
    gone = staged(judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(gone_id)).distinct())
    out = df.join(small_side(gone), F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
    twice = staged(judged.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice_id)))
    if twice.isEmpty():
        return out
    same = F.col(f"`{id_col}`") == F.col(twice_id)
    return out.join(twice, same, "left_anti").transform(stacked, out.join(twice, same, "left_semi").dropDuplicates([id_col, text_col]))
