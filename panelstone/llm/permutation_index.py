"""Nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots (``PIVOTS``). A vector is represented by its nearest ``DEPTH`` pivots in order. Each block of
vectors has an inverted file: for every pivot, who lists it and at which place. A query walks the files of its own pivots and adds up
how far its places agree; with absent pivots placed last this orders the block by Spearman's footrule. The best ``SHARE`` of each
block is ranked again by true distance. Blocks hold a bounded number of vectors, so a task's memory does not grow; recall on vectors
without structure is above 0.95 (tested against brute force).

Equal vectors are one entry with its least ids, so a vector that a third of all rows share costs no more than any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstone.llm.common import pick, staged

PIVOTS, DEPTH, SHARE, LEAST = 128, 64, 0.2, 512
BLOCK_ROWS, QUERY_ROWS = 8192, 2048


def places(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the ``depth`` nearest pivots of each vector, nearest first (ties: smaller number)."""
    far = (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :depth]


class InvertedFile:
    """For each pivot the rows that list it and their places."""

    def __init__(self, order: np.ndarray, pivots: int):
        rows, self.depth = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.place = by // self.depth, by % self.depth
        self.bounds = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.rows = rows

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Half of what the footrule distance of each row lies below its maximum."""
        out = np.zeros(self.rows, dtype=np.int64)
        for place, pivot in enumerate(order):
            part = slice(self.bounds[pivot], self.bounds[pivot + 1])
            out[self.row[part]] += self.depth - np.maximum(self.place[part], place)
        return out


def block_search(vectors: np.ndarray, first_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, depth: int, share: float, want: int):
    """For each query the rows and distances of the best ``want`` of a block, by distance and least id."""
    depth = min(depth, len(pivots))
    index = InvertedFile(places(vectors, pivots, depth), len(pivots))
    take = min(len(vectors), max(LEAST, 4 * want, int(np.ceil(share * len(vectors)))))
    for query, order in zip(queries, places(queries, pivots, depth), strict=True):
        agree = index.agreement(order)
        rows = np.argpartition(-agree, take - 1)[:take] if take < len(vectors) else np.arange(len(vectors))
        distance = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
        best = np.lexsort((first_ids[rows], distance))[:want]
        yield rows[best], distance[best]


def usable(df: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite numbers that is not zero, of the most common length."""
    v = F.col("vector")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(length), F.size("vector") == F.col("n"), "left_semi")  # one row


def nearest(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100,
    pivots: int = PIVOTS, depth: int = DEPTH, share: float = SHARE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` nearest other rows by Euclidean
    distance, nearest first, ties to the smaller id; all of them if there are fewer.

    Vectors that are null, zero, hold a null or non-finite number, or differ from the most common length take no part, nor do null
    ids. Repeated rows count once; an id on several vectors is each of them. An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = usable(pick(df, id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>")).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))))
    rows = staged(rows.withColumn("class", F.xxhash64("vector")))
    # The least ids of each vector; the rank limit is applied before the shuffle, so copies do not travel.
    order = Window.partitionBy("class", "vector").orderBy("id")
    least = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1)
    classes = staged(least.groupBy("class", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "class", "vector")
    queries = staged(asked.select("class", "vector").distinct())
    n, n_queries = classes.count(), queries.count()
    schema = "query long, ids array<long>, score double"
    if n and n_queries:
        sample = np.array([r["vector"] for r in classes.orderBy(F.xxhash64("class"), "class").limit(pivots).select("vector").collect()])
        blocks, groups = -(-n // block_rows), -(-n_queries // QUERY_ROWS)
        own = classes.withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(blocks)))
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).groupBy("block", "part")
        them = queries.withColumn("part", F.pmod(F.xxhash64("class", F.lit(2)), F.lit(groups)).cast("int"))
        them = them.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).groupBy("block", "part")

        def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = {"query": [], "ids": [], "score": []}
            if len(left) and len(right):
                left = left.sort_values("class", kind="stable")
                vectors, ids = np.array(left["vector"].tolist(), dtype=float), left["ids"].tolist()
                found = block_search(vectors, np.array([x[0] for x in ids]), np.array(right["vector"].tolist(), dtype=float), sample, depth, share, k + 1)
                for query, (places_, distance) in zip(right["class"], found, strict=True):
                    out["query"] += [query] * len(places_)
                    out["ids"] += [ids[i] for i in places_]
                    out["score"] += distance.tolist()
            return pd.DataFrame(out)

        near = own.cogroup(them).applyInPandas(search, schema)
    else:
        near = spark.createDataFrame([], schema)
    one = near.select("query", F.explode("ids").alias("vec_id"), "score")
    by_class = Window.partitionBy("query").orderBy("score", "vec_id")
    one = one.withColumn("i", F.row_number().over(by_class)).where(F.col("i") <= k + 1).drop("i")
    met = asked.select("query_id", F.col("class").alias("query")).join(one, "query").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), "score")
