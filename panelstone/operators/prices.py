"""Price series: reshaping, split factors, liquidity, and the full set of price-derived metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import ANNUALISE, TRADING_DAYS, div, finite, mapped
from panelstone.operators.passes import Ordered, ordered
from panelstone.operators.rolling import Roll, add_positive, add_rolling_median, add_shift, along, rolling, rolling_drawdown, rolling_extreme
from panelstone.session import dealt

# Blume shrinkage of a raw beta toward one.
BLUME = 0.67
BETA_WINDOW = 3 * TRADING_DAYS
BY, ON = ["ticker"], "date"


def wide_to_long(wide: DataFrame, date: str, columns: list[str], value: str = "close") -> DataFrame:
    """One column per ticker to one row per (ticker, date); missing and non-positive closes are dropped."""
    long = wide.unpivot([date], columns, "ticker", value)
    return long.where(finite(value) > 0).dropDuplicates(["ticker", date])


def clean_bars(bars: DataFrame, sequence: str) -> DataFrame:
    """Drop unusable closes and keep the last bar loaded per (ticker, date)."""
    latest = F.row_number().over(Window.partitionBy("ticker", "date").orderBy(F.col(sequence).desc()))
    return bars.where(finite("close") > 0).withColumn("_r", latest).where("_r = 1").drop("_r")


def add_split_factor(prices: DataFrame) -> DataFrame:
    """Product of the splits strictly after each date: multiply a split-adjusted close by it for the as-traded price."""
    ratio = F.when(F.col("split_ratio") > 0, F.col("split_ratio")).otherwise(1.0)
    later = Window.partitionBy("ticker").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return prices.withColumn("_ratio", ratio).withColumn(
        "split_factor", F.coalesce(F.product("_ratio").over(later), F.lit(1.0))
    ).drop("_ratio")


def add_dollar_volume(prices: DataFrame) -> DataFrame:
    return prices.withColumn("dollar_volume", F.col("close_raw") * F.col("volume"))


def recent_median_dollar_volume(prices: DataFrame, days: int) -> DataFrame:
    """Median dollar volume per ticker over the last ``2 x days`` calendar days of the table."""
    end = prices.agg(F.max("date").alias("_end"))
    recent = prices.join(F.broadcast(end)).where(F.col("date") > F.date_sub("_end", 2 * days))
    return recent.groupBy("ticker").agg(F.median("dollar_volume").alias("median_dollar_volume"))


def benchmark_series(prices: DataFrame, benchmark: str) -> DataFrame:
    """``date, mkt_ret, mkt_close`` of one ticker; one row per session."""
    own = prices.where(F.col("ticker") == benchmark).select("date", F.col("close_adj").alias("mkt_close"))
    return own.withColumn("mkt_ret", div("mkt_close", F.lag("mkt_close", 1).over(Window.orderBy("date"))) - 1.0)


def with_market(
    prices: DataFrame, benchmark: str, sectors: DataFrame | None = None, sector_funds: dict[str, str] | None = None, exclude: list[str] | None = None, deal: bool = False
) -> DataFrame:
    """Join the benchmark series and, by sector, the sector fund's close onto each security's rows.

    ``deal`` deals the rows by ticker first: sectors then come to them, and they stay where a caller needs them.
    """
    funds = sector_funds or {}
    drop = set(funds.values()) | {benchmark} | set(exclude or [])
    own = prices.where(~F.col("ticker").isin(list(drop)))
    out = (dealt(own, *BY) if deal else own).join(F.broadcast(benchmark_series(prices, benchmark)), "date", "left")
    if sectors is not None and funds:
        tagged = sectors.select("ticker", mapped("sector", funds).alias("_fund"))
        closes = prices.where(F.col("ticker").isin(list(funds.values()))).select(
            "date", F.col("ticker").alias("_fund"), F.col("close_adj").alias("sector_close")
        )
        # At most one row per (session, sector fund): bounded by the calendar times the fixed list of sectors.
        out = out.join(tagged, "ticker", "left").join(F.broadcast(closes), ["date", "_fund"], "left").drop("_fund")
    else:
        out = out.withColumn("sector_close", F.lit(None).cast("double"))
    return out


def add_returns(df: DataFrame | Ordered, price: str = "close_adj") -> DataFrame | Ordered:
    """One-day return, momentum with the last month skipped, and trailing returns."""
    w = along(BY, ON)
    back = lambda n: F.lag(price, n).over(w)
    p = F.col(price)
    return df.withColumns(
        {
            "ret_1d": div(p, back(1)) - 1.0,
            "mom_12_1": div(back(21), back(252)) - 1.0,
            "mom_6_1": div(back(21), back(126)) - 1.0,
            "ret_3m": div(p, back(63)) - 1.0,
            "ret_6m": div(p, back(126)) - 1.0,
            "ret_12m": div(p, back(252)) - 1.0,
        }
    )


def add_relative_strength(df: DataFrame | Ordered) -> DataFrame | Ordered:
    """Six-month return over the benchmark's and the sector fund's, lags counted on the security's own rows."""
    w = along(BY, ON)
    six = lambda x: div(x, F.lag(x, 126).over(w)) - 1.0
    return df.withColumns(
        {
            "rel_strength_spy": F.col("ret_6m") - six("mkt_close"),
            "rel_strength_sector": F.col("ret_6m") - six("sector_close"),
        }
    )


def add_trend(df: DataFrame | Ordered, price: str = "close_adj") -> DataFrame | Ordered:
    p = F.col(price)
    out = rolling(df, BY, ON, [Roll("_ma50", "mean", price, 50), Roll("_ma200", "mean", price, 200)])
    out = rolling_extreme(out, BY, ON, price, 252, "_high252")
    out = add_shift(out, "_ma200", 63, BY, ON, "_ma200_before")
    tiny = 1e-12
    return out.withColumns(
        {
            "px_over_ma50": p / (F.col("_ma50") + tiny) - 1.0,
            "px_over_ma200": p / (F.col("_ma200") + tiny) - 1.0,
            "near_52w_high": p / (F.col("_high252") + tiny) - 1.0,
            "ma200_slope": F.col("_ma200") / (F.col("_ma200_before") + tiny) - 1.0,
        }
    ).drop("_ma50", "_ma200", "_ma200_before", "_high252")


def add_consistency(df: DataFrame | Ordered, window: int = 252, min_n: int = 126) -> DataFrame | Ordered:
    """Share of the last year's rows on which the trailing month's summed excess return was positive."""
    out = rolling(df, BY, ON, [Roll("_month_excess", "sum", F.col("ret_1d") - F.col("mkt_ret"), 21)])
    out = add_positive(out, "_month_excess", "_won")
    return rolling(out, BY, ON, [Roll("momentum_consistency", "mean", "_won", window, min_n)]).drop("_month_excess", "_won")


def risk_rolls() -> list[Roll]:
    """Volatility, semideviation, betas and price impact as rolling specifications over ``ret_1d``."""
    r, m = F.col("ret_1d"), F.col("mkt_ret")
    falling = m < 0
    volume = F.col("dollar_volume")
    return [
        Roll("volatility", "std", "ret_1d", 252, 120, scale=ANNUALISE),
        Roll("volatility_3m", "std", "ret_1d", 63, 40, scale=ANNUALISE),
        Roll("downside_deviation", "rms", F.pow(F.least(r, F.lit(0.0)), 2) + r * 0.0, 252, 40, full=True, scale=ANNUALISE),
        Roll("beta_raw", "beta", "ret_1d", BETA_WINDOW, 120, y="mkt_ret", full=True),
        Roll("downside_beta", "beta", F.when(falling, r), BETA_WINDOW, 40, y=F.when(falling, m), full=True),
        Roll("amihud", "mean", F.when(volume > 0, div(F.abs(r), volume) * 1e6), 63, 40, full=True),
    ]


def build_price_metrics(
    prices: DataFrame, benchmark: str, sectors: DataFrame | None = None, sector_funds: dict[str, str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Every price metric, one row per (ticker, date).

    One shuffle by ticker and one sort; the lags are the planner's, all frames are merged from arrays as the sorted rows pass.
    """
    df = ordered(with_market(prices, benchmark, sectors, sector_funds, exclude, deal=True), BY, ON, deal=False)
    df = add_relative_strength(add_returns(df)).drop("mkt_close", "sector_close", "ret_6m", "ret_12m")
    df = add_consistency(add_trend(df))
    df = rolling(df, BY, ON, risk_rolls())
    df = add_rolling_median(df, "dollar_volume", BY, ON, 60, 20, "dollar_volume_median")
    df = rolling_drawdown(df, BY, ON, "close_adj", 252, "max_drawdown_1y")
    df = rolling_drawdown(df, BY, ON, "close_adj", 1260, "max_drawdown_5y")
    df = df.withColumn("beta", BLUME * F.col("beta_raw") + (1.0 - BLUME)).drop("mkt_ret")
    out = df.passed().frame
    last = ["px_over_ma50", "px_over_ma200", "near_52w_high", "ma200_slope", "momentum_consistency", *[s.name for s in risk_rolls()]]
    last += ["beta", "dollar_volume_median", "max_drawdown_1y", "max_drawdown_5y"]
    return out.select(*[x for x in out.columns if x not in last], *last)
