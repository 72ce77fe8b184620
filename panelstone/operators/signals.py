"""Technical features of the factor model and of the signal store, and rolling regressions on market and sector returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import ANNUALISE, div
from panelstone.operators.rolling import Roll, along, rolling, rolling_extreme, rolling_median
from panelstone.session import dealt

TINY = 1e-12


def _over(a, b) -> Column:
    return div(a, (F.col(b) if isinstance(b, str) else b) + TINY)


def technical_features(df: DataFrame, by: str = "ticker", date: str = "date", price: str = "close") -> DataFrame:
    """Momentum, trend, volatility, residual and liquidity features; needs ``price``, ``mkt_ret`` and ``dollar_volume``.

    The older drawdown form is kept on purpose: it compares each price with its own trailing high, so the trough may meet a peak
    from up to two windows back.
    """
    keys, df = [by], dealt(df, by)
    w = along(keys, date)
    p, r, m, v = F.col(price), F.col("ret_1d"), F.col("mkt_ret"), F.col("dollar_volume")
    back = lambda n: F.lag(price, n).over(w)
    out = df.withColumns(
        {
            "ret_1d": div(p, back(1)) - 1.0,
            "ret_5d": div(p, back(5)) - 1.0,
            "ret_63d": div(p, back(63)) - 1.0,
            "mom_12_1": div(back(21), back(252)) - 1.0,
            "mom_6_1": div(back(21), back(126)) - 1.0,
        }
    )
    out = rolling(
        out,
        keys,
        date,
        [
            Roll("_ma50", "mean", p, 50),
            Roll("_ma200", "mean", p, 200),
            Roll("up_day_ratio", "mean", (r > 0).cast("double"), 63),
            Roll("vol_63d", "std", r, 63, scale=ANNUALISE),
            Roll("downside_vol_126d", "std", F.when(r < 0, r), 126, 20, scale=ANNUALISE),
            Roll("_r", "mean", r, 252),
            Roll("_m", "mean", m, 252),
            Roll("_rm", "mean", r * m, 252),
            Roll("_mm", "mean", m * m, 252),
            Roll("amihud_illiq", "mean", _over(F.abs(r), v) * 1e9, 63),
            Roll("_v21", "mean", v, 21),
            Roll("_v252", "mean", v, 252),
        ],
    )
    out = rolling_extreme(out, keys, date, price, 252, "_high")
    out = out.withColumns(
        {
            "px_over_ma50": _over(p, "_ma50") - 1.0,
            "px_over_ma200": _over(p, "_ma200") - 1.0,
            "ma_50_200": _over("_ma50", "_ma200") - 1.0,
            "near_52w_high": _over(p, "_high") - 1.0,
            "beta_252d": _over(F.col("_rm") - F.col("_r") * F.col("_m"), F.col("_mm") - F.col("_m") * F.col("_m")),
            "volume_trend": _over("_v21", "_v252") - 1.0,
            "log_dollar_volume": F.log(rolling_median("dollar_volume", keys, date, 21, 21) + 1.0),
        }
    ).withColumn("_resid", r - F.col("beta_252d") * m)
    resid = F.col("_resid")
    out = rolling(
        out,
        keys,
        date,
        [Roll("_s126", "sum", resid, 126), Roll("_s21", "sum", resid, 21), Roll("idio_vol_126d", "std", resid, 126, scale=ANNUALISE)],
    ).withColumn("resid_mom_126d", F.col("_s126") - F.col("_s21"))
    out = rolling_extreme(out, keys, date, "near_52w_high", 252, "max_drawdown_252d", low=True)
    return out.drop("_ma50", "_ma200", "_r", "_m", "_rm", "_mm", "_v21", "_v252", "_high", "_resid", "_s126", "_s21")


def rsi(df: DataFrame, by: str, date: str, ret: str, window: int = 14, name: str = "rsi14") -> DataFrame:
    """Relative strength index on simple averages of gains and losses; a missing return counts as neither."""
    r = F.col(ret)
    gain, loss = F.when(r > 0, r).otherwise(0.0), F.when(r < 0, -r).otherwise(0.0)
    out = rolling(df, [by], date, [Roll("_g", "mean", gain, window), Roll("_l", "mean", loss, window)])
    return out.withColumn(name, 100.0 - div(100.0, 1.0 + _over("_g", "_l"))).drop("_g", "_l")


def macd(df: DataFrame, by: str, date: str, price: str) -> DataFrame:
    """MACD line, signal and histogram on simple moving averages (the names say EMA, the arithmetic does not)."""
    p = F.col(price)
    out = rolling(df, [by], date, [Roll("ema12", "mean", p, 12), Roll("ema26", "mean", p, 26)])
    out = out.withColumn("macd", F.col("ema12") - F.col("ema26"))
    out = rolling(out, [by], date, [Roll("macd_signal", "mean", F.col("macd"), 9)])
    return out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def signal_features(df: DataFrame, by: str = "entity", date: str = "asof") -> DataFrame:
    """Returns, averages, price-to-average, close-to-close and range volatility, volume structure, RSI and MACD."""
    df, w = dealt(df, by), along([by], date)
    p, v, rv = F.col("close"), F.col("volume"), F.col("rv_range_close")
    lags = {1: "ret_1d", 5: "ret_5d", 20: "ret_20d", 60: "ret_60d", 90: "ret_90d", 120: "ret_120d", 180: "ret_180d"}
    out = df.withColumns({name: div(p, F.lag("close", n).over(w)) - 1.0 for n, name in lags.items()})
    r = F.col("ret_1d")
    specs = [Roll(f"ma{n}", "mean", p, n) for n in (10, 20, 50, 100, 200)]
    specs += [Roll(f"vol_cc_{n}", "std", r, n) for n in (20, 60, 90)]
    specs += [Roll(f"rv_rc_{n}", "mean", rv, n) for n in (20, 60, 90)]
    specs.append(Roll("vol_ma20", "mean", v, 20))
    out = rolling(out, [by], date, specs).withColumns(
        {
            **{f"px_over_ma{n}": _over(p, f"ma{n}") - 1.0 for n in (20, 100, 200)},
            "vol_rel_20": _over(v, "vol_ma20") - 1.0,
        }
    )
    return macd(rsi(out, by, date, "ret_1d"), by, date, "close")


def signals_to_wide(signals: DataFrame, kinds: dict[str, str], by: str = "entity", date: str = "asof") -> DataFrame:
    """Long signal rows to one row per (entity, date): kind -> column, the mean of its values."""
    return signals.groupBy(by, date).agg(*[F.avg(F.when(F.col("kind") == k, F.col("value"))).alias(c) for k, c in kinds.items()])


def add_market_sector_returns(df: DataFrame, date: str = "asof", ret: str = "ret_1d", sector: str | None = None) -> DataFrame:
    """Equal-weight mean return per date, and per date and sector. The means are aggregated, then joined back."""
    market = df.groupBy(date).agg(F.avg(ret).alias("mkt_ret_1d"))
    out = df.join(F.broadcast(market), date, "left")  # one row per session
    if sector is None:
        return out.withColumn("sector_ret_1d", F.lit(None).cast("double"))
    means = df.groupBy(date, sector).agg(F.avg(ret).alias("sector_ret_1d"))
    return out.join(means, [date, sector], "left")


def rolling_regression(df: DataFrame, by: str, date: str, window: int = 60, two_factor: bool = False, prefix: str = "resid") -> DataFrame:
    """Rolling OLS with intercept of ``ret_1d`` on the market (and the sector) return.

    Every variable is centred on its own trailing mean first and the second moments are then averaged, as the signal store does.
    Produces betas, alpha, the residual and its 20- and 60-row mean and deviation (``_cum_`` is a mean).
    """
    keys, df = [by], dealt(df, by)
    y, x1, x2 = "ret_1d", "mkt_ret_1d", "sector_ret_1d"
    used = [y, x1, x2] if two_factor else [y, x1]
    out = rolling(df, keys, date, [Roll(f"_b_{x}", "mean", F.col(x), window) for x in used])
    centred = {x: F.col(x) - F.col(f"_b_{x}") for x in used}
    moments = {"v11": centred[x1] * centred[x1], "c1": centred[x1] * centred[y]}
    if two_factor:
        moments |= {"v22": centred[x2] * centred[x2], "v12": centred[x1] * centred[x2], "c2": centred[x2] * centred[y]}
    out = rolling(out, keys, date, [Roll(f"_{k}", "mean", e, window) for k, e in moments.items()])
    g = lambda k: F.col(f"_{k}")
    mean = lambda x: F.col(f"_b_{x}")
    if two_factor:
        det = g("v11") * g("v22") - g("v12") * g("v12") + 1e-18
        b1 = div(g("c1") * g("v22") - g("v12") * g("c2"), det)
        b2 = div(g("c2") * g("v11") - g("v12") * g("c1"), det)
        out = out.withColumns({f"beta_mkt_{window}d": b1, f"beta_sec_{window}d": b2})
        fit = lambda a, b: F.col(f"beta_mkt_{window}d") * a + F.col(f"beta_sec_{window}d") * b
        out = out.withColumn(f"alpha_{window}d", mean(y) - fit(mean(x1), mean(x2)))
        fitted = F.col(f"alpha_{window}d") + fit(F.col(x1), F.col(x2))
    else:
        out = out.withColumn(f"beta_mkt_{window}d", div(g("c1"), g("v11") + TINY))
        beta = F.col(f"beta_mkt_{window}d")
        out = out.withColumn(f"alpha_{window}d", mean(y) - beta * mean(x1))
        fitted = F.col(f"alpha_{window}d") + beta * F.col(x1)
    out = out.withColumn(f"{prefix}_1d", F.col(y) - fitted)
    e = F.col(f"{prefix}_1d")
    out = rolling(
        out,
        keys,
        date,
        [Roll(f"{prefix}_cum_{n}d", "mean", e, n) for n in (20, 60)] + [Roll(f"{prefix}_vol_{n}d", "std", e, n) for n in (20, 60)],
    )
    return out.drop(*[f"_b_{x}" for x in used], *[f"_{k}" for k in moments])


def forward_return(
    df: DataFrame, horizon: int, by: str, date: str, price: str = "close", log: bool = True, benchmark: str | None = None, sector: str | None = None
) -> DataFrame:
    """Return over the next ``horizon`` rows, optionally over the benchmark's and over the sector mean."""
    w = Window.partitionBy(by).orderBy(date)
    name = f"fwd{horizon}_ret"
    ratio = div(F.lead(price, horizon).over(w), price)
    value = F.log(F.when(ratio > 0, ratio)) if log else ratio - 1.0
    out = df.withColumn(name, F.when(F.col(price) > 0, value))
    if benchmark is not None:
        market = out.where(F.col(by) == benchmark).select(date, F.col(name).alias("_m"))
        out = out.join(F.broadcast(market), date, "left").withColumn(f"{name}_ex_mkt", F.col(name) - F.col("_m")).drop("_m")  # one row per session
    if sector is not None:
        means = out.groupBy(date, sector).agg(F.avg(name).alias("_s"))
        out = out.join(means, [date, sector], "left").withColumn(f"{name}_ex_sec", F.col(name) - F.col("_s")).drop("_s")
    return out
