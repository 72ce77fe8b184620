"""Report queries over scored tables: lists, details, peers, histograms, trends, and quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import div
from panelstone.functions.spec import NOT_SCORED, SCORE_BANDS
from panelstone.session import stacked


def newest(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows of the latest date only."""
    last = df.agg(F.max(date).alias(date))
    return df.join(F.broadcast(last), date, "left_semi")  # one row


def ranked_list(scores: DataFrame, companies: DataFrame, limit: int, extras: list[DataFrame] | None = None) -> DataFrame:
    """Latest ranked list with company attributes and whatever else is known, best rank first, unranked last."""
    out = newest(scores).join(companies.select("ticker", "sector", "industry"), "ticker", "left")
    for extra in extras or []:
        out = out.join(extra, ["company_id", "date"], "left")
    return out.orderBy(F.col("rank").asc_nulls_last(), "ticker").limit(limit)


def stock_detail(metric_scores: DataFrame) -> DataFrame:
    """Each metric's contribution to its category score."""
    cell = ["company_id", "date", "category"]
    seen = F.col("status") == "scored"
    total = metric_scores.groupBy(*cell).agg(F.sum(F.when(seen, F.col("weight"))).alias("_w"))
    out = metric_scores.join(total, cell, "left")
    return out.withColumn("contribution", F.when(seen, div(F.col("score") * F.col("weight"), "_w"))).drop("_w")


def strengths_weaknesses(metric_scores: DataFrame, high: float = 85.0, low: float = 15.0, k: int = 8) -> DataFrame:
    """Up to ``k`` metrics per company at either end. A company has one row per declared metric."""
    s = metric_scores.where(F.col("status") == "scored").withColumn("_s", F.round("score", 9))
    up = Window.partitionBy("company_id", "date").orderBy(F.col("_s").desc(), "metric")
    down = Window.partitionBy("company_id", "date").orderBy(F.col("_s").asc(), "metric")
    strong = s.where(F.col("_s") >= high).withColumn("_r", F.row_number().over(up)).withColumn("side", F.lit("strength"))
    weak = s.where(F.col("_s") <= low).withColumn("_r", F.row_number().over(down)).withColumn("side", F.lit("weakness"))
    return strong.transform(stacked, weak).where(F.col("_r") <= k).drop("_r", "_s")


def peers(scored: DataFrame, k: int = 12, min_industry: int = 4) -> DataFrame:
    """The best-scored peers of every company: its industry, or its sector when the industry is too small.

    Everyone in a group shares the same best names, so each group first keeps its ``k + 1`` best (a rank limit ahead of the
    shuffle); a company then drops itself. No pairs of a whole group are formed.
    """
    known = scored.where(F.col("score").isNotNull())
    best = (F.col("score").desc(), F.col("ticker").asc())

    def leaders(basis: str, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*best)
        top = known.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
        return top.select(*keys, F.col("ticker").alias("peer"), F.col("score").alias("peer_score"), F.lit(basis).alias("basis"))

    sizes = known.groupBy("sector", "industry").agg(F.count(F.lit(1)).alias("_n"))
    asked = known.select("ticker", "sector", "industry").join(sizes, ["sector", "industry"])
    narrow = asked.where(F.col("_n") - 1 >= min_industry).join(leaders("industry", ["sector", "industry"]), ["sector", "industry"])
    wide = asked.where(F.col("_n") - 1 < min_industry).join(leaders("sector", ["sector"]), "sector")
    cols = ["ticker", "peer", "peer_score", "basis"]
    both = narrow.select(*cols).transform(stacked, wide.select(*cols)).where(F.col("peer") != F.col("ticker"))
    w = Window.partitionBy("ticker").orderBy(F.col("peer_score").desc(), F.col("peer").asc())  # at most k + 1 rows
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def filter_list(rows: DataFrame, sectors=None, bands=None, min_score: float | None = None, text: str | None = None) -> DataFrame:
    out = rows
    if sectors:
        out = out.where(F.col("sector").isin(sectors))
    if bands:
        out = out.where(F.col("band").isin(bands))
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if text:
        out = out.where(F.lower("ticker").contains(text.lower()))
    return out


def hidden_unscored(rows: DataFrame, min_score: float) -> DataFrame:
    """How many rows a score filter hides only because they carry no score."""
    return rows.agg(F.count_if(F.col("score").isNull()).alias("hidden_unscored"), F.count_if(F.col("score") >= min_score).alias("shown"))


def count_by_band(rows: DataFrame) -> DataFrame:
    """Counts in declared band order, zero where a band is empty."""
    bands = [label for _, label in SCORE_BANDS] + [NOT_SCORED]
    declared = rows.sparkSession.createDataFrame([(b, i) for i, b in enumerate(bands)], "band string, k int")
    counts = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return declared.join(counts, "band", "left").select("band", "k", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bin_scores(rows: DataFrame, width: int, top: float = 100.0) -> DataFrame:
    """Histogram with empty bins; the top edge belongs to the last bin."""
    bins = int(top // width)
    number = F.least(F.floor(F.col("score") / float(width)), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col("score").isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mean_by_sector(rows: DataFrame) -> DataFrame:
    """Mean score per sector plus the overall mean."""
    known = rows.where(F.col("score").isNotNull())
    agg = [F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")]
    return known.groupBy("sector").agg(*agg).transform(stacked, known.agg(*agg).select(F.lit("All").alias("sector"), "mean_score", "n"))


def price_tail(prices: DataFrame, n: int) -> DataFrame:
    """Last ``n`` bars per ticker with the latest change. A ticker has one bar per session."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    change = div("close_adj", F.lag("close_adj", 1).over(Window.partitionBy("ticker").orderBy("date"))) - 1.0
    out = prices.withColumns({"_r": F.row_number().over(w), "change": change})
    return out.where(F.col("_r") <= n).withColumn("is_last", F.col("_r") == 1).drop("_r")


def financial_trend(fundamentals: DataFrame, n: int) -> DataFrame:
    """Latest value of each period, last ``n`` periods per company and concept."""
    key = ["company_id", "concept"]
    per = fundamentals.groupBy(*key, "period_end").agg(F.max_by("value", F.struct("available_at", "value")).alias("value"))
    w = Window.partitionBy(*key).orderBy(F.col("period_end").desc())
    return per.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def freshness(fundamentals: DataFrame, as_of: Column) -> DataFrame:
    return fundamentals.groupBy("company_id", "concept").agg(F.max("available_at").alias("latest"), F.count(F.lit(1)).alias("n")).withColumn(
        "age_days", F.datediff(as_of, "latest")
    )


def next_catalyst(events: DataFrame, as_of: Column) -> DataFrame:
    ahead = events.where(F.col("event_date") > as_of)
    return ahead.groupBy("company_id").agg(F.min_by(F.struct("event_date", "event_type"), F.struct("event_date", "event_type")).alias("_e")).select("company_id", "_e.*")


def thin_curve(paths: DataFrame, step: int, run: str = "run_id") -> DataFrame:
    """Every ``step``-th point and the last one, rebased to the first. A run has one point per session."""
    w = Window.partitionBy(run).orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = paths.withColumns({"_i": F.row_number().over(w) - 1, "_last": F.max("date").over(whole), "_first": F.first("equity").over(whole)})
    kept = out.where((F.col("_i") % step == 0) | (F.col("date") == F.col("_last")))
    return kept.select(run, "date", div("equity", "_first").alias("level"))


def recent_trials(trials: DataFrame, limit: int, fields: dict[str, str]) -> DataFrame:
    """Newest trials with values pulled out of their JSON parameters."""
    out = trials.orderBy(F.col("recorded_at").desc(), "trial_id").limit(limit)
    return out.select("trial_id", "recorded_at", *[F.get_json_object("params", p).alias(n) for n, p in fields.items()])


# ---- quality checks: each yields rows of (severity, check, subject, detail)


def issue(df: DataFrame, severity: str, check: str, subject: str, detail: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def thin_history(observations: DataFrame, today: Column, min_facts: int = 1500, min_days: int = 730) -> DataFrame:
    """Companies with few facts, or whose first filing is recent."""
    per = observations.groupBy("company_id").agg(F.count(F.lit(1)).alias("facts"), F.min("filed").alias("first_filed"))
    return per.where((F.col("facts") < min_facts) | (F.datediff(today, "first_filed") < min_days))


def price_disagreement(own: DataFrame, other: DataFrame, limit: float = 0.15) -> DataFrame:
    """Last price against a second source, where they differ by more than ``limit``."""
    last = own.groupBy("ticker").agg(F.max_by("close_raw", "date").alias("price"))
    gap = div(F.abs(F.col("price") - F.col("other_price")), F.abs("other_price"))
    return last.join(other, "ticker").withColumn("gap", gap).where(F.col("gap") > limit)


def share_count_disagreement(fundamentals: DataFrame, limit: float = 0.15) -> DataFrame:
    """Reported shares against net income over earnings per share, judged by the better of two share concepts."""
    pick = lambda c: F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.col("available_at"))).alias(c)
    wide = fundamentals.groupBy("company_id").agg(*[pick(c) for c in ("net_income", "eps_diluted", "shares_diluted", "shares_outstanding")])
    wide = wide.withColumn("implied", div("net_income", "eps_diluted")).where(F.col("implied") > 0)
    gap = lambda c: F.abs(div(c, "implied") - 1.0)
    return wide.withColumn("gap", F.least(gap("shares_diluted"), gap("shares_outstanding"))).where(F.col("gap") > limit)


def score_coverage(scores: DataFrame, floor: float = 0.7, share: float = 0.15) -> DataFrame:
    """Latest date: unscored names, names under the coverage floor, and whether those are too many."""
    out = newest(scores).agg(
        F.count(F.lit(1)).alias("names"),
        F.count_if(F.col("score").isNull()).alias("unscored"),
        F.count_if(F.col("coverage") < floor).alias("thin"),
    )
    return out.withColumn("too_thin", div("thin", "names") > share)


def stale_filings(observations: DataFrame, current: DataFrame, today: Column, days: int = 150) -> DataFrame:
    last = observations.join(current.select("company_id").distinct(), "company_id", "left_semi").groupBy("company_id").agg(F.max("filed").alias("last_filed"))
    return last.withColumn("age_days", F.datediff(today, "last_filed")).where(F.col("age_days") > days)


def snapshot_count(estimates: DataFrame) -> DataFrame:
    return estimates.agg(F.countDistinct("as_of").alias("snapshots"), F.min("as_of").alias("first"), F.max("as_of").alias("last"))


def check_all(issues: list[DataFrame]) -> DataFrame:
    """All issues, worst first."""
    both = reduce(stacked, issues)
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return both.orderBy(order, "check", "subject")
