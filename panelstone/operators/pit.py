"""Point-in-time assembly of reported facts.

A fact is (company, concept, start, end, filed, available_at, value, accession, tag_rank); an instant has no start. What was known
on a date is rebuilt for every date on which something became available, from everything that its company had reported on that
concept by then: no period is too old to be restated or to be subtracted from a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from panelstone.session import PART_BYTES, cut_lineage, dealt, stacked

# A year's coverage, slack between chained periods, usable slice lengths, pieces per year, scale guard.
YEAR_MIN, YEAR_MAX = 350, 385
CHAIN_SLACK = 4
SLICE_MIN, SLICE_MAX = 20, 400
MAX_PIECES = 8
SCALE_FACTOR, SCALE_MIN_FACTS, SCALE_SIDE, SCALE_MIN_SIDE = 50.0, 6, 4, 3
KEY = ["company_id", "concept"]


def map_tags(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Observations to facts: a tag may serve several concepts; units must agree. The catalogue is a small declared table."""
    tags = F.broadcast(catalogue.select("concept", "tag", "unit", "tag_rank", "period_type", "aggregation"))
    return observations.join(tags, ["tag", "unit"])


def primary_concept(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The concept a tag serves with the best preference rank."""
    best = catalogue.groupBy("tag").agg(F.min_by("concept", F.struct("tag_rank", "concept")).alias("concept"))
    return observations.join(F.broadcast(best), "tag", "left")


def dedupe_facts(observations: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row per key, the last by ``newest``. A map-side-combined aggregate, so copies of one fact never meet in one sort."""
    rest = [x for x in observations.columns if x not in keys]
    best = observations.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(newest)).alias("_r"))
    return best.select(*keys, "_r.*").select(*observations.columns)


def assign_revisions(observations: DataFrame) -> DataFrame:
    """Revision number of each value of a period, and whether it restates the first one."""
    w = Window.partitionBy("company_id", "tag", "unit", "period_start", "period_end").orderBy("filed", "accession")
    first = F.first("value").over(w)
    moved = F.abs(F.col("value") - first) > F.abs(first) * 1e-6 + 1e-6
    return observations.withColumns({"revision": F.row_number().over(w) - 1, "_moved": moved}).withColumn(
        "is_restatement", (F.col("revision") > 0) & F.col("_moved")
    ).drop("_moved")


def length_bucket() -> Column:
    days = F.datediff("end", "start")
    return F.when(F.col("start").isNull(), "instant").when(days <= 120, "quarter").when(days <= 250, "half").otherwise("year")


def flag_scale_outliers(facts: DataFrame) -> DataFrame:
    """Mark values more than 50 times out of line with every neighbourhood that is large enough to judge.

    A neighbourhood is the up to four positive magnitudes before (or after) within the same length bucket; its yardstick is the
    upper-middle value.
    """
    group = [*KEY, "_bucket"]
    order = Window.partitionBy(*group).orderBy("end", "filed", "accession", "tag_rank")
    size = F.abs("value")

    def verdict(lo: int, hi: int) -> Column:
        near = F.sort_array(F.collect_list(F.when(size > 0, size)).over(order.rowsBetween(lo, hi)))
        n = F.size(near)
        mid = F.get(near, F.floor(n / 2).cast("int"))
        out = (size > mid * SCALE_FACTOR) | (size < mid / SCALE_FACTOR)
        return F.when(n >= SCALE_MIN_SIDE, out)

    everything = Window.partitionBy(*group)
    total = Window.partitionBy(*KEY)
    judged = facts.withColumn("_bucket", length_bucket()).withColumns(
        {
            "_before": verdict(-SCALE_SIDE, -1),
            "_after": verdict(1, SCALE_SIDE),
            "_n": F.count(F.lit(1)).over(everything),
            "_all": F.count(F.lit(1)).over(total),
        }
    )
    known = F.col("_before").isNotNull() | F.col("_after").isNotNull()
    every = F.coalesce("_before", F.lit(True)) & F.coalesce("_after", F.lit(True))
    bad = (F.col("_n") >= SCALE_MIN_FACTS) & (F.col("_all") >= SCALE_MIN_FACTS) & (size > 0) & known & every
    return judged.withColumn("scale_outlier", bad).drop("_bucket", "_before", "_after", "_n", "_all")


def reject_scale_outliers(facts: DataFrame) -> DataFrame:
    return flag_scale_outliers(facts).where(~F.col("scale_outlier")).drop("scale_outlier")


def knowledge_dates(facts: DataFrame) -> DataFrame:
    """Dates on which something became known, with the newest period end known by then."""
    per = facts.groupBy(*KEY, F.col("available_at").alias("as_of")).agg(F.max("end").alias("_end"))
    upto = Window.partitionBy(*KEY).orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*KEY, "as_of", F.max("_end").over(upto).alias("newest_end"))


def _best() -> Column:
    """Later filing wins; within a filing the preferred tag; then the accession, to leave nothing to chance."""
    return F.struct(F.col("filed"), (-F.col("tag_rank")).alias("preference"), F.col("accession"))


def known_periods(facts: DataFrame) -> DataFrame:
    """For every knowledge date: the value then known for each duration period, however old.

    A concept of a company has a few periods a year, so the dates and facts that meet here are bounded by its reporting calendar.
    """
    spans = facts.where(F.col("start").isNotNull())
    asked = knowledge_dates(spans).select(*KEY, "as_of")
    met = asked.join(spans, KEY).where(F.col("available_at") <= F.col("as_of"))
    values = F.struct("value", "available_at", "accession", "tag_rank")
    return met.groupBy(*KEY, "as_of", "start", "end").agg(F.max_by(values, _best()).alias("_v")).select(*KEY, "as_of", "start", "end", "_v.*")


def decompose(known: DataFrame, scope: list[str]) -> DataFrame:
    """Cumulative cuts that share a start become the slices between them; a slice is known once both cuts are."""
    w = Window.partitionBy(*scope, "start").orderBy("end")
    prev = lambda x: F.lag(x, 1).over(w)
    sliced = known.withColumns({"_pe": prev("end"), "_pv": prev("value"), "_pa": prev("available_at"), "_pc": prev("accession")})
    out = sliced.select(
        *scope,
        F.coalesce("_pe", "start").alias("start"),
        "end",
        (F.col("value") - F.coalesce("_pv", F.lit(0.0))).alias("value"),
        F.greatest("available_at", "_pa").alias("available_at"),
        F.filter(F.array("accession", "_pc"), lambda x: x.isNotNull()).alias("accessions"),
    ).withColumn("days", F.datediff("end", "start"))
    return out.where(F.col("days").between(SLICE_MIN, SLICE_MAX))


def shortest_by_end(slices: DataFrame, scope: list[str]) -> DataFrame:
    body = F.struct("start", "value", "available_at", "accessions", "days")
    order = F.struct("days", F.size("accessions").alias("n"), "value")
    return slices.groupBy(*scope, "end").agg(F.min_by(body, order).alias("_s")).select(*scope, "end", "_s.*")


def preceding(slices: DataFrame, scope: list[str]) -> DataFrame:
    """For every slice, the end of the nearest slice that finishes at its start or up to four days earlier.

    Each slice is offered under the five days it could precede, so the lookup is an equi-join.
    """
    offered = slices.select(*scope, F.col("end").alias("preceding_end"), F.explode(F.sequence("end", F.date_add("end", CHAIN_SLACK))).alias("_day"))
    found = slices.select(*scope, "end", F.col("start").alias("_day")).join(offered, [*scope, "_day"])
    return found.groupBy(*scope, "end").agg(F.max("preceding_end").alias("preceding_end"))


def trailing_year(slices: DataFrame, scope: list[str]) -> DataFrame:
    """Chain slices back from the newest until a year is covered; a broken chain yields no row.

    The slices of one knowledge date are few (its trailing window), so the walk is a fold over a short sorted array.
    """
    one = F.struct("end", "start", "value", "available_at", "accessions")
    chains = shortest_by_end(slices, scope).groupBy(*scope).agg(F.sort_array(F.collect_list(one), asc=False).alias("_p"))
    head = F.element_at("_p", 1)
    first = F.struct(
        head["start"].alias("cursor"),
        head["value"].alias("total"),
        F.lit(1).alias("pieces"),
        head["available_at"].alias("available_at"),
        head["accessions"].alias("accessions"),
        F.lit(False).alias("broken"),
    )

    def step(acc: Column, p: Column) -> Column:
        covered = F.datediff(head["end"], acc["cursor"])
        walking = ~acc["broken"] & (covered < YEAR_MIN) & (acc["pieces"] < MAX_PIECES)
        reachable = p["end"] <= acc["cursor"]
        near = p["end"] >= F.date_sub(acc["cursor"], CHAIN_SLACK)
        taken = F.struct(
            p["start"].alias("cursor"),
            (acc["total"] + p["value"]).alias("total"),
            (acc["pieces"] + 1).alias("pieces"),
            F.greatest(acc["available_at"], p["available_at"]).alias("available_at"),
            F.concat(acc["accessions"], p["accessions"]).alias("accessions"),
            F.lit(False).alias("broken"),
        )
        snapped = acc.withField("broken", F.lit(True))
        return F.when(walking & reachable & near, taken).when(walking & reachable, snapped).otherwise(acc)

    rest = F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(1)))
    out = chains.select(*scope, head["end"].alias("period_end"), F.aggregate(rest, first, step).alias("_a"))
    covered = F.datediff("period_end", F.col("_a.cursor"))
    return out.where(~F.col("_a.broken") & covered.between(YEAR_MIN, YEAR_MAX)).select(
        *scope,
        "period_end",
        F.col("_a.total").alias("value"),
        F.col("_a.pieces").alias("n_sources"),
        F.col("_a.available_at").alias("last_piece_at"),
        F.array_distinct("_a.accessions").alias("accessions"),
        (F.col("_a.pieces") > 1).alias("is_derived"),
    )


def only_changes(series: DataFrame) -> DataFrame:
    """Keep the dates on which (period_end, value) changed. One row per knowledge date of a company's concept."""
    w = Window.partitionBy(*KEY).orderBy("as_of")
    same = F.lag("period_end", 1).over(w).eqNullSafe(F.col("period_end")) & F.lag("value", 1).over(w).eqNullSafe(F.col("value"))
    return series.withColumn("_same", same).where(~F.col("_same")).drop("_same")


SERIES = [*KEY, "basis", "value", "period_end", "available_at", "n_sources", "accessions", "is_derived"]


def _series(df: DataFrame, basis: str) -> DataFrame:
    return df.withColumns({"basis": F.lit(basis), "available_at": F.col("as_of")}).select(*SERIES)


def ttm_series(facts: DataFrame) -> DataFrame:
    """Trailing-year totals, one row per date on which the answer changed."""
    scope = [*KEY, "as_of"]
    totals = trailing_year(decompose(known_periods(facts), scope), scope)
    return _series(only_changes(totals), "ttm")


def latest_level_series(facts: DataFrame) -> DataFrame:
    """For quantities that do not add up over time: the newest, shortest, best-tagged positive value."""
    order = F.struct(F.col("end"), (-F.datediff("end", "start")).alias("d"), (-F.col("tag_rank")).alias("t"))
    found = known_periods(facts).where(F.col("value") > 0).groupBy(*KEY, "as_of").agg(
        F.max_by(F.struct(F.col("end").alias("period_end"), "value", "accession"), order).alias("_b")
    )
    flat = found.select(
        *KEY, "as_of", "_b.period_end", "_b.value", F.lit(1).alias("n_sources"), F.array("_b.accession").alias("accessions"), F.lit(False).alias("is_derived")
    )
    return _series(only_changes(flat), "quarter")


def instant_series(facts: DataFrame) -> DataFrame:
    """Balance-sheet levels: the newest known period end's best value, on every date it changed."""
    points = facts.where(F.col("start").isNull())
    dates = knowledge_dates(points).withColumn("end", F.col("newest_end"))
    met = dates.join(points, [*KEY, "end"]).where(F.col("available_at") <= F.col("as_of"))
    best = met.groupBy(*KEY, "as_of", "end").agg(F.max_by(F.struct("value", "accession"), _best()).alias("_v"))
    flat = best.select(
        *KEY, "as_of", F.col("end").alias("period_end"), "_v.value", F.lit(1).alias("n_sources"), F.array("_v.accession").alias("accessions"), F.lit(False).alias("is_derived")
    )
    return _series(only_changes(flat), "instant")


def build_fundamentals(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All concepts of all companies: sums for flows, latest levels for averages, instants for the balance sheet."""
    facts = map_tags(observations, catalogue).select(
        *KEY,
        F.col("period_start").alias("start"),
        F.col("period_end").alias("end"),
        "filed", "available_at", "value", "accession", "tag_rank", "period_type", "aggregation",
    )
    # A fact meets every later date of its concept, so parts are small; dealt by company and concept, one shuffle serves all that follows.
    known = cut_lineage(reject_scale_outliers(dealt(facts, *KEY, part_bytes=PART_BYTES // 8)))
    facts = dealt(known, *KEY, part_bytes=PART_BYTES // 8)
    flows = facts.where((F.col("period_type") == "duration") & (F.col("aggregation") == "sum"))
    levels = facts.where((F.col("period_type") == "duration") & (F.col("aggregation") == "last"))
    points = facts.where(F.col("period_type") == "instant")
    return ttm_series(flows).transform(stacked, latest_level_series(levels)).transform(stacked, instant_series(points))
