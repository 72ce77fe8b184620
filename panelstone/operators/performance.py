"""Statistics of equity paths. A path has one row per session, so windows per run are bounded by the calendar."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelstone.functions.numeric import TRADING_DAYS, div, finite
from panelstone.session import stacked

EULER_GAMMA = 0.5772156649015329  # fixed value
RUN = "run_id"


def _along(run: str = RUN):
    return Window.partitionBy(run).orderBy("date")


def add_equity_returns(paths: DataFrame, value: str = "equity", name: str = "ret") -> DataFrame:
    return paths.withColumn(name, div(value, F.lag(value, 1).over(_along())) - 1.0)


def _per_session_rate(annual: float) -> float:
    return (1.0 + annual) ** (1.0 / TRADING_DAYS) - 1.0


def basic_statistics(paths: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """Total return, CAGR on the calendar, volatility, Sharpe, Sortino, worst drawdown, Calmar."""
    upto = _along().rowsBetween(Window.unboundedPreceding, 0)
    df = add_equity_returns(paths).withColumn("_dd", div("equity", F.max("equity").over(upto)) - 1.0)
    excess = finite("ret") - _per_session_rate(risk_free)
    out = df.groupBy(RUN).agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.count("equity").alias("n_sessions"),
        F.min_by("equity", "date").alias("_first"),
        F.max_by("equity", "date").alias("final_equity"),
        F.stddev_samp(finite("ret")).alias("_sd"),
        F.avg(excess).alias("_mean"),
        F.sqrt(F.avg(F.pow(F.when(excess < 0, excess).when(excess.isNotNull(), 0.0), 2))).alias("_down"),
        F.min("_dd").alias("max_drawdown"),
        F.count(finite("ret")).alias("_n"),
    )
    years = F.datediff("end", "start") / 365.25
    scale = math.sqrt(TRADING_DAYS)
    ok = (F.col("n_sessions") >= 2) & (F.col("_first") > 0)
    growth = div("final_equity", "_first")
    out = out.withColumns(
        {
            "years": years,
            "total_return": F.when(ok, growth - 1.0),
            "cagr": F.when(ok & (years > 0), F.pow(growth, div(1.0, years)) - 1.0),
            "volatility": F.when(F.col("_n") >= 2, F.col("_sd") * scale),
            "sharpe": F.when((F.col("_n") >= 2) & (F.col("_sd") > 0), F.col("_mean") / F.col("_sd") * scale),
            "sortino": F.when((F.col("_n") >= 2) & (F.col("_down") > 0), F.col("_mean") / F.col("_down") * scale),
        }
    ).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))
    return out.drop("_first", "_sd", "_mean", "_down", "_n")


def drawdown_episodes(paths: DataFrame) -> DataFrame:
    """Peak-to-recovery episodes: start, trough, recovery (null while open) and length in calendar days."""
    upto = _along().rowsBetween(Window.unboundedPreceding, 0)
    at_peak = (F.col("equity") >= F.max("equity").over(upto)).cast("int")
    tagged = paths.withColumn("_peak", at_peak).withColumn("_episode", F.sum("_peak").over(upto))
    spells = tagged.groupBy(RUN, "_episode").agg(
        F.min("date").alias("start"),
        F.max("date").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by("date", F.struct("equity", "date")).alias("trough"),
    )
    spells = spells.withColumn("recovered", F.lead("start").over(Window.partitionBy(RUN).orderBy("_episode")))
    days = F.datediff(F.coalesce("recovered", "_last"), "start")
    return spells.where(F.col("_n") > 1).select(RUN, "start", "trough", "recovered", days.alias("days"))


def drawdown_duration(paths: DataFrame) -> DataFrame:
    """The longest episode per run, the earliest among equals."""
    episodes = drawdown_episodes(paths)
    order = F.struct("days", (-F.unix_date("start")).alias("s"))
    return episodes.groupBy(RUN).agg(F.max_by(F.struct("days", "start", "trough", "recovered"), order).alias("_e")).select(RUN, "_e.*")


def benchmark_statistics(paths: DataFrame, benchmark: str = "benchmark", risk_free: float = 0.0) -> DataFrame:
    """Beta, annualised alpha, tracking error, information ratio and up/down capture against a benchmark level column."""
    df = add_equity_returns(add_equity_returns(paths), benchmark, "bret")
    df = df.select(RUN, finite("ret").alias("r"), finite("bret").alias("b")).where("r is not null and b is not null")
    rf = _per_session_rate(risk_free)
    up, down = F.col("b") > 0, F.col("b") < 0
    out = df.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp("r", "b").alias("_cov"),
        F.var_samp("b").alias("_var"),
        F.avg("r").alias("_r"),
        F.avg("b").alias("_b"),
        F.avg(F.col("r") - F.col("b")).alias("_d"),
        F.stddev_samp(F.col("r") - F.col("b")).alias("_ds"),
        F.avg(F.when(up, F.col("r"))).alias("_ru"),
        F.avg(F.when(up, F.col("b"))).alias("_bu"),
        F.count_if(up).alias("_nu"),
        F.avg(F.when(down, F.col("r"))).alias("_rd"),
        F.avg(F.when(down, F.col("b"))).alias("_bd"),
        F.count_if(down).alias("_nd"),
    )
    scale, enough = math.sqrt(TRADING_DAYS), F.col("n") >= 30
    beta = F.when(enough & (F.col("_var") > 0), F.col("_cov") / F.col("_var"))
    daily_alpha = (F.col("_r") - rf) - beta * (F.col("_b") - rf)
    wide = F.col("n") >= TRADING_DAYS // 4
    return out.select(
        RUN,
        "n",
        beta.alias("beta"),
        (F.pow(1.0 + daily_alpha, TRADING_DAYS) - 1.0).alias("alpha_annual"),
        F.when(F.col("n") >= 2, F.col("_ds") * scale).alias("tracking_error"),
        F.when(enough & (F.col("_ds") > 0), F.col("_d") / F.col("_ds") * scale).alias("information_ratio"),
        F.when(wide & (F.col("_nu") >= 10), div("_ru", "_bu")).alias("upside_capture"),
        F.when(wide & (F.col("_nd") >= 10), div("_rd", "_bd")).alias("downside_capture"),
    )


def periodic_returns(paths: DataFrame, unit: str = "MM", value: str = "equity") -> DataFrame:
    """Return of each calendar month ('MM') or year ('YYYY'); the first is anchored at the first value."""
    ends = paths.groupBy(RUN, F.trunc("date", unit).alias("period")).agg(
        F.max_by(value, "date").alias("_end"), F.min_by(value, "date").alias("_begin")
    )
    before = F.coalesce(F.lag("_end").over(Window.partitionBy(RUN).orderBy("period")), F.col("_begin"))
    return ends.select(RUN, "period", (div("_end", before) - 1.0).alias("return"))


def rolling_outperformance(paths: DataFrame, months: int, benchmark: str = "benchmark") -> DataFrame:
    """Over every window of ``21 x months`` sessions: how often the path beat its benchmark."""
    n = 21 * months
    w = _along()
    gap = div("equity", F.lag("equity", n).over(w)) - div(benchmark, F.lag(benchmark, n).over(w))
    gaps = paths.select(RUN, finite(gap).alias("_g")).where("_g is not null")
    return gaps.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("_g") > 0).alias("beat"),
        F.avg((F.col("_g") > 0).cast("double")).alias("share"),
        F.median("_g").alias("median_excess"),  # one value per session of a run
        F.min("_g").alias("worst_excess"),
        F.max("_g").alias("best_excess"),
    )


def bootstrap_intervals(paths: DataFrame, samples: int = 1000, block: int = 21, level: float = 0.95, seed: int = 7) -> DataFrame:
    """Moving-block bootstrap intervals of CAGR and Sharpe per run.

    Block starts come from a hash of (seed, run, sample, block), so a recomputed task draws the same blocks. A block's sums are
    differences of running totals, so a sample costs one row per block rather than one per session.
    """
    w = Window.partitionBy(RUN).orderBy("date")
    r = add_equity_returns(paths).where(finite("ret").isNotNull()).select(RUN, "date", "ret")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    totals = r.select(
        RUN,
        F.row_number().over(w).alias("i"),
        F.sum("ret").over(upto).alias("s"),
        F.sum(F.col("ret") * F.col("ret")).over(upto).alias("ss"),
        F.sum(F.log1p("ret")).over(upto).alias("lg"),
    )
    zero = totals.select(RUN).distinct().select(RUN, F.lit(0).alias("i"), *[F.lit(0.0).alias(x) for x in ("s", "ss", "lg")])
    totals = totals.transform(stacked, zero)
    sizes = r.groupBy(RUN).agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= 4 * block)
    draws = (
        sizes.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)))
        .withColumn("from", F.pmod(F.xxhash64(F.lit(seed), RUN, "sample", "b"), F.col("n") - block + 1).cast("int"))
        .withColumn("to", F.col("from") + F.least(F.lit(block), F.col("n") - F.col("b") * block))
    )
    at = lambda end, tag: totals.select(RUN, F.col("i").alias(end), *[F.col(x).alias(f"{x}_{tag}") for x in ("s", "ss", "lg")])
    sums = draws.join(at("from", "a"), [RUN, "from"]).join(at("to", "z"), [RUN, "to"])
    per = sums.groupBy(RUN, "sample", "n").agg(*[F.sum(F.col(f"{x}_z") - F.col(f"{x}_a")).alias(x) for x in ("s", "ss", "lg")])
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(div(F.col("ss") - F.col("s") * mean, F.col("n") - 1), F.lit(0.0)))
    per = per.select(
        RUN,
        (F.exp(F.col("lg") * TRADING_DAYS / F.col("n")) - 1.0).alias("cagr"),
        F.when(sd > 0, mean / sd * math.sqrt(TRADING_DAYS)).alias("sharpe"),
    )
    tail = (1.0 - level) / 2.0
    # ``samples`` values per run: a parameter bounds the group.
    return per.groupBy(RUN).agg(
        *[F.percentile(x, F.lit(q)).alias(f"{x}_{side}") for x in ("cagr", "sharpe") for side, q in (("low", tail), ("high", 1 - tail))]
    )


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    nd = NormalDist()
    return x.map(lambda v: nd.cdf(v) if pd.notna(v) else None)


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    nd = NormalDist()
    return p.map(lambda v: nd.inv_cdf(v) if pd.notna(v) and 0.0 < v < 1.0 else None)


def return_moments(paths: DataFrame) -> DataFrame:
    """Observation count, per-session Sharpe ratio, skew and kurtosis (standardised by the sample deviation)."""
    r = add_equity_returns(paths).select(RUN, finite("ret").alias("r")).where("r is not null")
    base = r.groupBy(RUN).agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    z = div(F.col("r") - F.col("m"), "sd")
    higher = r.join(base, RUN).groupBy(RUN, "n", "m", "sd").agg(F.avg(F.pow(z, 3)).alias("skew"), F.avg(F.pow(z, 4)).alias("kurtosis"))
    return higher.where("sd > 0").select(RUN, "n", (F.col("m") / F.col("sd")).alias("sr"), "skew", "kurtosis")


def deflated_sharpe(moments: DataFrame, trials: int, sharpe_variance: Column | None = None, min_n: int = 60) -> DataFrame:
    """Probability that the true Sharpe ratio exceeds what the best of ``trials`` unskilled attempts would show."""
    var = F.lit(1.0) / F.col("n") if sharpe_variance is None else sharpe_variance
    spread = F.sqrt(F.greatest(var, F.lit(1e-12)))
    df = moments.where(F.col("n") >= min_n)
    if trials > 1:
        q1, q2 = normal_quantile(F.lit(1 - 1 / trials)), normal_quantile(F.lit(1 - 1 / (trials * math.e)))
        df = df.withColumn("expected_max", spread * ((1 - EULER_GAMMA) * q1 + EULER_GAMMA * q2))
    else:
        df = df.withColumn("expected_max", F.lit(0.0))
    sr = F.col("sr")
    noise = F.sqrt(F.greatest(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4.0 * sr * sr, F.lit(1e-12)))
    df = df.withColumn("probability", normal_cdf((sr - F.col("expected_max")) * F.sqrt(F.col("n") - 1.0) / noise))
    scale = math.sqrt(TRADING_DAYS)
    verdict = (
        F.when(F.col("probability") >= 0.95, "survives deflation at the 95% level")
        .when(F.col("probability") >= 0.90, "marginal after deflation")
        .otherwise("does not survive deflation")
    )
    return df.select(
        RUN, (sr * scale).alias("sharpe_annual"), (F.col("expected_max") * scale).alias("expected_max_sharpe_annual"),
        "probability", "skew", "kurtosis", F.col("n").alias("n_obs"), verdict.alias("verdict"),
    )


def overfitting_partitions(returns: DataFrame, splits: int = 8, run: str = RUN, period: str = "period", value: str = "return") -> DataFrame:
    """Per balanced split of the periods: the best in-sample run and the logit of its out-of-sample rank.

    Runs are summed per block once; each of the C(splits, splits/2) partitions then adds block sums.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    periods = returns.select(period).distinct()
    placed = periods.select(period, (F.row_number().over(Window.orderBy(period)) - 1).alias("_i"), n.alias("_n"))  # one row per period
    size, extra = F.floor(F.col("_n") / splits), F.col("_n") % splits
    wide = extra * (size + 1)
    block = F.when(F.col("_i") < wide, F.floor(F.col("_i") / (size + 1))).otherwise(extra + F.floor(div(F.col("_i") - wide, size)))
    sums = (
        returns.join(F.broadcast(placed.select(period, block.cast("int").alias("block"))), period)
        .groupBy(run, "block")
        .agg(F.count(value).alias("k"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    )
    chosen = list(combinations(range(splits), splits // 2))
    sides = [
        F.struct(F.lit(i).alias("split"), F.array(*[F.lit(b in combo) for b in range(splits)]).alias("inside")) for i, combo in enumerate(chosen)
    ]
    both = sums.withColumn("_p", F.explode(F.array(*sides)))
    part = both.groupBy(F.col("_p.split").alias("split"), run).agg(
        *[
            F.sum(F.when(F.element_at("_p.inside", F.col("block") + 1) == F.lit(side), F.col(x)).otherwise(0.0)).alias(f"{x}_{tag}")
            for side, tag in ((True, "in"), (False, "out"))
            for x in ("k", "s", "ss")
        ]
    )

    def ratio(tag: str) -> Column:
        k, s, ss = F.col(f"k_{tag}"), F.col(f"s_{tag}"), F.col(f"ss_{tag}")
        sd = F.sqrt(F.greatest(div(ss - div(s * s, k), k - 1), F.lit(0.0)))
        return F.when(sd > 0, div(div(s, k), sd))

    part = part.select("split", run, ratio("in").alias("sin"), F.coalesce(ratio("out"), F.lit(float("-inf"))).alias("sout"))
    best = part.groupBy("split").agg(F.max_by(F.struct(run, "sout"), F.struct("sin", run)).alias("_b"), F.count(F.lit(1)).alias("n_trials"))
    worse = F.count_if((F.col("sout") < F.col("_b.sout")) | ((F.col("sout") == F.col("_b.sout")) & (F.col(run) <= F.col(f"_b.{run}"))))
    ranked = part.join(F.broadcast(best), "split").groupBy("split", "n_trials", F.col(f"_b.{run}").alias("best_run")).agg(worse.alias("rank"))  # one row per partition
    relative = F.greatest(F.least(F.col("rank") / (F.col("n_trials") + 1), F.lit(1 - 1e-6)), F.lit(1e-6))
    return ranked.withColumn("logit", F.log(relative / (1 - relative)))


def overfitting_probability(returns: DataFrame, splits: int = 8, **names) -> DataFrame:
    parts = overfitting_partitions(returns, splits, **names)
    out = parts.agg(
        F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"),
        F.median("logit").alias("median_logit"),  # one value per partition
        F.count(F.lit(1)).alias("n_partitions"),
        F.max("n_trials").alias("n_trials"),
    )
    return out.withColumn(
        "verdict",
        F.when(F.col("pbo") >= 0.5, "selection among these trials looks like noise").otherwise(
            "the in-sample winner tends to hold up out of sample"
        ),
    )


def benchmark_path(prices: DataFrame, dates: DataFrame, benchmark: str) -> DataFrame:
    """A benchmark's closes on the given dates, forward-filled and rebased to one at the first priced date."""
    own = prices.where(F.col("ticker") == benchmark).select("date", "close_adj")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = dates.select("date").join(own, "date", "left").withColumn("level", F.last("close_adj", ignorenulls=True).over(w))
    return filled.select("date", div("level", F.first("close_adj", ignorenulls=True).over(w)).alias("level"))


def risk_matched(paths: DataFrame, benchmark: str = "benchmark") -> DataFrame:
    """Benchmark compounded after scaling its returns to the path's volatility."""
    df = add_equity_returns(add_equity_returns(paths), benchmark, "bret")
    vols = df.groupBy(RUN).agg(div(F.stddev_samp(finite("ret")), F.stddev_samp(finite("bret"))).alias("ratio"))
    upto = _along().rowsBetween(Window.unboundedPreceding, 0)
    step = 1.0 + F.coalesce(F.col("ratio") * F.col("bret"), F.lit(0.0))
    return df.join(vols, RUN).select(RUN, "date", "ratio", F.product(step).over(upto).alias("level"))


def summarise(paths: DataFrame, benchmark: str = "benchmark") -> DataFrame:
    """Headline and benchmark-relative statistics as long rows (run, metric, value)."""
    months = periodic_returns(paths).groupBy(RUN).agg(
        F.avg((F.col("return") > 0).cast("double")).alias("positive_months"), F.max("return").alias("best_month"), F.min("return").alias("worst_month")
    )
    wide = basic_statistics(paths).join(benchmark_statistics(paths, benchmark), RUN, "left").join(months, RUN, "left")
    keep = [
        "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "beta", "alpha_annual", "tracking_error",
        "information_ratio", "upside_capture", "downside_capture", "positive_months", "best_month", "worst_month",
    ]
    return wide.unpivot([RUN], keep, "metric", "value")


def trial_return_matrix(paths: DataFrame, min_months: int = 1) -> DataFrame:
    """Month returns per run, long; runs that miss any month of the common calendar are dropped."""
    monthly = periodic_returns(paths)
    spread = monthly.agg(F.countDistinct("period").alias("_all"))
    complete = monthly.groupBy(RUN).agg(F.count(F.lit(1)).alias("_k")).join(F.broadcast(spread)).where("_k = _all").where(F.col("_k") >= min_months)
    return monthly.join(complete.select(RUN), RUN, "left_semi")
