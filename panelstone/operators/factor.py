"""The factor model: cross-sectional normalisation, group scores, weighting, ratings; and its fundamental ratios."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import clip, div, safe_div, zero_if_null
from panelstone.functions.spec import FEATURES
from panelstone.operators.ranking import add_rank, group_quantiles

MIN_GROUP_COVERAGE = 0.34  # fixed value
EPS = 1e-9


def groups() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, group, _ in FEATURES:
        out.setdefault(group, []).append(name)
    return out


def group_column(group: str) -> str:
    return "g_" + group.lower().replace(" ", "_")


def melt(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).cast("double").alias("value")) for x in columns])
    return df.select(*ids, F.explode(cells).alias("_c")).select(*ids, "_c.*")


def normalise_long(long: DataFrame, winsor: float, sector: str | None = "sector", directions: dict[str, int] | None = None, date: str = "date") -> DataFrame:
    """Winsorise, demean by sector median, standardise, orient and clip every feature within its date.

    Input is long (…, date, sector, feature, value). Limits and medians come from exact group quantiles, moments from plain
    aggregates: nothing windows a whole date. Output adds ``z`` (zero where the value is missing) and ``has``.
    """
    keys = [date, "feature"]
    limits = group_quantiles(long, keys, "value", nearest={"_lo": winsor, "_hi": 1.0 - winsor}).drop("n")
    out = long.join(limits, keys, "left").withColumn("_w", clip(F.col("value"), F.col("_lo"), F.col("_hi")))
    if sector is not None:
        medians = group_quantiles(out, [*keys, sector], "_w", linear={"_mid": 0.5}).drop("n")
        out = out.join(medians, [*keys, sector], "left").withColumn("_w", F.col("_w") - F.col("_mid")).drop("_mid")
    moments = out.groupBy(*keys).agg(F.avg("_w").alias("_mean"), F.stddev_samp("_w").alias("_dev"))
    sign = F.lit(1)
    for name, d in (directions or {x: d for x, _, d in FEATURES}).items():
        if d < 0:
            sign = F.when(F.col("feature") == name, F.lit(-1)).otherwise(sign)
    z = div(F.col("_w") - F.col("_mean"), F.col("_dev") + EPS) * sign
    out = out.join(moments, keys, "left").withColumns(
        {"z": F.coalesce(clip(z, -4.0, 4.0), F.lit(0.0)), "has": F.col("value").isNotNull().cast("double")}
    )
    return out.drop("_lo", "_hi", "_w", "_mean", "_dev")


def zscore_by_date(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """(x - mean) / (sample deviation + 1e-9) within each date, from aggregates joined back."""
    stats = df.groupBy(date).agg(
        *[F.avg(x).alias(f"_m_{x}") for x in columns], *[F.stddev_samp(x).alias(f"_s_{x}") for x in columns]
    )
    out = df.join(F.broadcast(stats), date, "left")  # one row per date
    out = out.withColumns({x: div(F.col(x) - F.col(f"_m_{x}"), F.col(f"_s_{x}") + EPS) for x in columns})
    return out.drop(*[f"_{k}_{x}" for k in "ms" for x in columns])


def demean_by_date(df: DataFrame, column: str, date: str = "date") -> DataFrame:
    stats = df.groupBy(date).agg(F.avg(column).alias("_m"))
    return df.join(F.broadcast(stats), date, "left").withColumn(column, F.col(column) - F.col("_m")).drop("_m")  # one row per date


def group_scores_long(z: DataFrame, ids: list[str], sizes: dict[str, int]) -> DataFrame:
    """Mean observed z per group with its coverage; a group needs a third of its features (at least one).

    ``z`` is long with ``group``, ``z`` and ``has``; ``sizes`` is the number of features present per group.
    """
    per = z.groupBy(*ids, "group").agg(F.sum(F.col("z") * F.col("has")).alias("_z"), F.sum("has").alias("_n"))
    size = reduce(lambda acc, kv: F.when(F.col("group") == kv[0], F.lit(float(kv[1]))).otherwise(acc), sizes.items(), F.lit(1.0))
    enough = F.col("_n") >= F.greatest(F.lit(1.0), size * MIN_GROUP_COVERAGE)
    return per.select(*ids, "group", div("_n", size).alias("coverage"), F.when(enough, div("_z", "_n")).alias("score"))


def apply_weights(df: DataFrame, weights: dict[str, float], date: str = "date") -> DataFrame:
    """Signed weighted sum renormalised by the absolute weight available, contributions, agreement, score and percentile."""
    has = {c: F.col(c).isNotNull() for c in weights}
    available = reduce(add, [F.when(has[c], abs(w)).otherwise(0.0) for c, w in weights.items()])
    out = df.withColumn("weight_available", available)
    scale = F.when(F.col("weight_available") > 0, F.col("weight_available")).otherwise(1.0)
    out = out.withColumns({f"contrib_{c}": F.coalesce(div(F.col(c) * w, scale), F.lit(0.0)) for c, w in weights.items()})
    active = reduce(add, [(has[c] & F.lit(abs(w) > EPS)).cast("double") for c, w in weights.items()])
    positive = reduce(add, [(has[c] & (F.col(f"contrib_{c}") > 0)).cast("double") for c in weights])
    out = out.withColumn("score_raw", reduce(add, [F.col(f"contrib_{c}") for c in weights]))
    share = div(positive, active)
    out = out.withColumn("agreement", F.when(F.col("score_raw") >= 0, share).otherwise(1.0 - share))
    stats = out.groupBy(date).agg(F.avg("score_raw").alias("_m"), F.stddev_samp("score_raw").alias("_s"))
    out = out.join(F.broadcast(stats), date, "left").withColumn("score", div(F.col("score_raw") - F.col("_m"), F.col("_s") + EPS))  # one row per date
    return add_rank(out.drop("_m", "_s"), [date], "score", percentile="percentile")


def rate(percentile: str = "percentile", agreement: str = "agreement") -> Column:
    """Buy and avoid need agreement; a rank alone earns accumulate or reduce."""
    p, agree = F.col(percentile), F.coalesce(agreement, F.lit(0.5))
    return (
        F.when(p.isNull(), "hold")
        .when((p >= 0.90) & (agree >= 0.6), "buy")
        .when(p >= 0.75, "accumulate")
        .when((p <= 0.10) & (agree >= 0.6), "avoid")
        .when(p <= 0.25, "reduce")
        .otherwise("hold")
    )


def top_contributions(df: DataFrame, ids: list[str], weights: dict[str, float], k: int) -> DataFrame:
    """The ``k`` largest contributions by magnitude per row, sorted inside the row's own short array."""
    cells = F.array(
        *[
            F.when(
                F.col(c).isNotNull(),
                F.struct((-F.abs(f"contrib_{c}")).alias("o"), F.lit(c).alias("group"), F.col(c).alias("z"), F.col(f"contrib_{c}").alias("contribution"), F.lit(w).alias("weight")),
            )
            for c, w in weights.items()
        ]
    )
    best = F.slice(F.sort_array(F.filter(cells, lambda x: x.isNotNull())), 1, k)
    return df.select(*ids, F.posexplode(best).alias("place", "_c")).select(
        *ids, (F.col("place") + 1).alias("place"), "_c.group", "_c.z", "_c.contribution", "_c.weight"
    )


def fundamental_features(df: DataFrame, by: str = "ticker", date: str = "date", year: int = 252) -> DataFrame:
    """Twenty ratios of the older factor block, growth against ``year`` rows earlier."""
    col = F.col
    w = Window.partitionBy(by).orderBy(date)
    over = lambda a, b: safe_div(a, b, positive_only=True)
    out = df.withColumns(
        {
            "market_cap": col("close_split") * col("shares") * col("split_factor"),
            "_fcf": col("operating_cash_flow") - col("capex"),
            "_debt": zero_if_null("debt_long") + zero_if_null("debt_current"),
            "operating_margin": safe_div("operating_income", "revenue"),
        }
    )
    out = out.withColumns(
        {
            "earnings_yield": over("net_income", "market_cap"),
            "sales_yield": over("revenue", "market_cap"),
            "fcf_yield": over("_fcf", "market_cap"),
            "book_to_price": over("equity", "market_cap"),
            "roe": over("net_income", "equity"),
            "roa": over("net_income", "assets"),
            "gross_margin": safe_div("gross_profit", "revenue"),
            "accruals": over(col("net_income") - col("operating_cash_flow"), "assets"),
            "leverage": over("_debt", "equity"),
            "current_ratio": over("current_assets", "current_liabilities"),
            "buyback_yield": over("buyback", "market_cap"),
            "dividend_yield": over("dividends_paid", "market_cap"),
            "capex_intensity": over("capex", "revenue"),
            "rnd_intensity": over("rnd", "revenue"),
        }
    )
    was = lambda x: F.lag(x, year).over(w)
    change = lambda x: safe_div(col(x) - was(x), F.abs(was(x)))
    return out.withColumns(
        {
            "revenue_growth": change("revenue"),
            "earnings_growth": change("net_income"),
            "fcf_growth": change("_fcf"),
            "margin_trend": col("operating_margin") - was("operating_margin"),
        }
    ).drop("_fcf", "_debt")


def sanitise(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Non-finite features to null, medians in their place (zero when a feature has none), rows without a target dropped.

    Medians come from the value ladder, one pass for all features, and return as a single row.
    """
    from panelstone.functions.numeric import finite

    clean = df.withColumns({x: finite(x) for x in [*features, target]})
    medians = group_quantiles(melt(clean, [], features), ["feature"], "value", linear={"mid": 0.5})
    row = medians.groupBy().agg(*[F.max(F.when(F.col("feature") == x, F.col("mid"))).alias(f"_m_{x}") for x in features])
    out = clean.join(F.broadcast(row))  # one row
    out = out.withColumns({x: F.coalesce(x, f"_m_{x}", F.lit(0.0)) for x in features})
    return out.where(F.col(target).isNotNull()).drop(*[f"_m_{x}" for x in features])
