"""Run registry, gates, robustness verdicts and the overall conclusion, as joins against declared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstone.functions.numeric import div

# Data gates (key, metric measured, minimum, status it caps).
DATA_GATES = (
    ("historical_membership", "exits_observed", 1.0, "exploratory_only"),
    ("delisted_prices", "removed_priced_share", 0.95, "exploratory_only"),
    ("delisting_returns", "delisting_known_share", 1.0, "exploratory_only"),
    ("point_in_time_fundamentals", "point_in_time", 1.0, "not_testable"),
    ("no_estimate_lookahead", "estimates_excluded", 1.0, "not_testable"),
    ("execution_delay", "execution_delay_days", 1.0, "not_testable"),
    ("benchmark_coverage", "benchmark_coverage", 1.0, "exploratory_only"),
)
# Result gates (key, metric, minimum).
RESULT_GATES = (
    ("ic_positive", "ic_mean_3m", 0.01),
    ("ic_significant", "ic_t_3m", 2.0),
    ("decile_spread", "decile_spread_3m", 0.0),
    ("monotonic", "decile_monotonicity", 0.5),
    ("net_excess", "excess_cagr_net_spy", 0.0),
    ("information_ratio", "information_ratio_net_spy", 0.3),
)
STATUS_ORDER = ("not_testable", "exploratory_only", "in_sample")
WEAKENED_BELOW, SHIFT_WEAKENED_BELOW, FAILED_BELOW = 0.5, 0.7, 0.0
MIN_DECISION_DATES, ROBUST_SHARE = 36, 0.7


def evaluate_gates(measurements: DataFrame, gates, run: str = "run_id") -> DataFrame:
    """Every gate for every run: measured value, threshold, passed. An unmeasured gate does not pass.

    ``measurements`` is long: run, metric, value. Both sides hold many rows a run, whatever the files they came from suggest (an exploded
    row counts once there), so they meet sorted and are never gathered in the driver.
    """
    spark = measurements.sparkSession
    caps = [g[3] if len(g) > 3 else None for g in gates]
    table = spark.createDataFrame([(g[0], g[1], float(g[2]), c) for g, c in zip(gates, caps)], "gate string, metric string, minimum double, caps string")
    runs = measurements.select(run).distinct()
    every = runs.withColumn("_g", F.explode(F.array(*[F.lit(g[0]) for g in gates]))).join(F.broadcast(table), F.col("_g") == F.col("gate")).drop("_g")
    out = every.join(measurements.select(run, "metric", "value").hint("merge"), [run, "metric"], "left")
    return out.withColumn("passed", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False))).select(run, "gate", "metric", "value", "minimum", "caps", "passed")


def cap_status(gates: DataFrame, run: str = "run_id") -> DataFrame:
    """The lowest status any failed data gate allows."""
    place = F.lit(len(STATUS_ORDER) - 1)
    for i, status in enumerate(STATUS_ORDER[:-1]):
        place = F.when(~F.col("passed") & (F.col("caps") == status), F.lit(i)).otherwise(place)
    low = gates.groupBy(run).agg(F.min(place).alias("_p"), F.count_if(~F.col("passed")).alias("failed_data_gates"))
    names = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return low.select(run, F.element_at(names, F.col("_p") + 1).alias("status"), "failed_data_gates")


def decide(data_gates: DataFrame, result_gates: DataFrame, periods: DataFrame, robustness: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """Status and conclusion per run. ``periods``: run, period, n_decision_dates; ``robustness``: run, survived_share."""
    status = cap_status(data_gates, run)
    results = result_gates.groupBy(run).agg(F.count_if("passed").alias("cleared"), F.count(F.lit(1)).alias("asked"))
    out = status.join(results, run).join(periods, run)
    out = out.join(robustness, run, "left") if robustness is not None else out.withColumn("survived_share", F.lit(None).cast("double"))
    all_clear = F.col("cleared") == F.col("asked")
    verdict = F.when(all_clear, "passed").otherwise("failed")
    final = F.when(F.col("status") != "in_sample", F.col("status")).when(F.col("period") == "development", "in_sample").otherwise(F.concat("period", F.lit("_"), verdict))
    robust = F.col("survived_share").isNull() | (F.col("survived_share") >= ROBUST_SHARE)
    conclusion = (
        F.when(F.col("status") == "not_testable", "backtest_invalid")
        .when(F.col("n_decision_dates") < MIN_DECISION_DATES, "insufficient_data")
        .when(F.col("failed_data_gates") > 0, "backtest_invalid")
        .when(all_clear & robust, "evidence_of_predictive_ability")
        .when(F.col("cleared") == 0, "no_meaningful_evidence")
        .otherwise("evidence_is_mixed")
    )
    return out.select(run, final.alias("status"), conclusion.alias("conclusion"), "cleared", "asked", "failed_data_gates")


def robustness_verdict(base: str = "base", value: str = "value", is_shift: str | Column | None = None) -> Column:
    """survived / weakened / failed against the base run; nothing to test when the base has no edge."""
    b, v = F.col(base), F.col(value)
    shift = F.lit(False) if is_shift is None else (F.col(is_shift) if isinstance(is_shift, str) else is_shift)
    limit = F.when(shift, SHIFT_WEAKENED_BELOW).otherwise(WEAKENED_BELOW)
    return (
        F.when(b.isNull() | v.isNull() | F.isnan(b) | F.isnan(v), "not_measurable")
        .when(b <= 0, "not_applicable")
        .when(v <= FAILED_BELOW, "failed")
        .when(div(v, b) < limit, "weakened")
        .otherwise("survived")
    )


def robustness_summary(tests: DataFrame, run: str = "run_id") -> DataFrame:
    kinds = ("survived", "weakened", "failed", "not_applicable", "not_measurable")
    out = tests.groupBy(run).agg(F.count(F.lit(1)).alias("n_tests"), *[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])
    applicable = F.col("n_tests") - F.col("not_applicable") - F.col("not_measurable")
    return out.withColumn("survived_share", div("survived", applicable))


def flatten_diagnostics(wide: DataFrame, run: str, keys: dict[str, object], columns: list[str]) -> DataFrame:
    """Wide statistics to long diagnostic rows with fixed key columns; missing keys carry a sentinel instead of null."""
    out = wide.unpivot([run, *[k for k in keys if k in wide.columns]], columns, "metric", "value")
    for name, sentinel in keys.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(sentinel)) if name in wide.columns else F.lit(sentinel))
    return out.select(run, *keys, "metric", "value")


def trades(weights: DataFrame, entity: str = "security_id", run: str = "run_id") -> DataFrame:
    """Weight changes between consecutive rebalances of a run as buy and sell rows."""
    from pyspark.sql import Window

    dates = weights.select(run, "date").distinct()
    nxt = dates.select(run, "date", F.lead("date").over(Window.partitionBy(run).orderBy("date")).alias("_next"))
    old = weights.join(nxt, [run, "date"]).where("_next is not null").select(run, entity, F.col("_next").alias("date"), F.col("weight").alias("_old"))
    both = weights.select(run, entity, "date", "weight").join(old, [run, entity, "date"], "full_outer")
    delta = F.coalesce("weight", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0))
    out = both.withColumn("delta_weight", delta).where(F.abs("delta_weight") > 1e-12)
    return out.select(run, "date", entity, F.when(F.col("delta_weight") > 0, "buy").otherwise("sell").alias("side"), "delta_weight")


def trial_count(trials: DataFrame, strategy: str | None = None) -> DataFrame:
    """Registered trials, at least one."""
    kept = trials if strategy is None else trials.where(F.col("strategy") == strategy)
    return kept.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_trials"))
