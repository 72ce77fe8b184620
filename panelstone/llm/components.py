"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstone.llm.common import staged
from panelstone.session import stacked


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction. Large: every node ties its larger neighbours to the least node around it. Small: its smaller ones.

    Neighbours of a hot node combine map-side into one minimum; the list of neighbours is never collected.
    """
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).transform(stacked, links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.transform(stacked, least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _print(links: DataFrame) -> tuple:
    """Size and content sums: equal for equal tables."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b`` (long ids); the component is its least node.

    Each round is written to the shared folder; rounds grow with the logarithm of the size. Only three sums reach the driver.
    """
    links = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _print(links)
    while seen[0]:
        links = staged(_star(_star(links, True), False))
        now = _print(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).transform(stacked, 
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
