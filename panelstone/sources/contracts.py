"""Declared tables: schema, key, required columns; checking, coercing, migrating and profiling frames against them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from panelstone.session import stacked


@dataclass(frozen=True)
class TableSpec:
    name: str
    layer: str
    ddl: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    entity: str | None = None
    date: str | None = None
    max_age_days: int | None = None
    renames: dict[str, str] = field(default_factory=dict)
    transform: Callable[[DataFrame], DataFrame] | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


def schema_problems(df: DataFrame, spec: TableSpec) -> list[tuple[str, str]]:
    """Differences between a frame's schema and the declared one (no data is read)."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in spec.schema}
    out = [("missing", x) for x in want if x not in have]
    out += [("extra", x) for x in have if x not in want]
    out += [("type", x) for x in want if x in have and have[x] != want[x]]
    return out


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One aggregate for all columns, returned long: ``column, nulls``."""
    wide = df.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in columns])
    return wide.unpivot([], columns, "column", "nulls")


def duplicate_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def validate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Problems of the data itself as rows: nulls in required columns and duplicated keys with three samples."""
    required = [x for x in (*spec.key, *spec.required) if x in df.columns]
    nulls = null_counts(df, list(dict.fromkeys(required))).where(F.col("nulls") > 0).select(
        F.lit("null_in_required").alias("problem"), F.col("column").alias("subject"), F.col("nulls").alias("n")
    )
    copies = duplicate_keys(df, spec)
    shown = copies.select(F.concat_ws("|", *[F.col(k).cast("string") for k in spec.key]).alias("subject")).orderBy("subject").limit(3)
    total = copies.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    sample = shown.agg(F.concat_ws(", ", F.sort_array(F.collect_list("subject"))).alias("subject"))  # three keys
    dup = total.join(F.broadcast(sample)).select(F.lit("duplicate_key").alias("problem"), "subject", "n")
    return nulls.transform(stacked, dup)


def coerce(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared columns in declared order; unreadable values become null, absent columns are added as typed nulls."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in spec.schema
        ]
    )


def migrate(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared renames and value fixes, applied on read."""
    out = df.withColumnsRenamed({old: new for old, new in spec.renames.items() if old in df.columns})
    return spec.transform(out) if spec.transform else out


def percent_to_fraction(df: DataFrame, column: str, limit: float = 10.0) -> DataFrame:
    """Divide by 100 when the column is evidently in percentage points (median magnitude above one); applying it twice is safe.

    The median comes from the value ladder and returns as one row.
    """
    from panelstone.functions.numeric import clip
    from panelstone.operators.ranking import group_quantiles

    sizes = df.select(F.lit(0).alias("_k"), F.abs(column).alias("_v"))
    median = group_quantiles(sizes, ["_k"], "_v", linear={"_median": 0.5}).select("_median")
    # An empty column has no median row: keep the rows and leave the values alone.
    out = df.join(F.broadcast(median), F.lit(True), "left")
    fixed = clip(F.col(column) / 100.0, -limit, limit)
    return out.withColumn(column, F.when(F.col("_median") > 1.0, fixed).otherwise(F.col(column))).drop("_median")


def membership_defaults(df: DataFrame) -> DataFrame:
    """Older membership rows lack bracket and precision columns: fill what follows from the rest."""
    return df.withColumns(
        {
            "entry_observed_by": F.coalesce("entry_observed_by", "entry_date"),
            "entry_precision": F.coalesce("entry_precision", F.when(F.col("entry_date").isNotNull(), "exact").otherwise("unknown")),
            "exit_precision": F.coalesce("exit_precision", F.when(F.col("exit_date").isNull(), "still_member").otherwise("bracketed")),
            "universe_version": F.coalesce("universe_version", F.lit("current-list")),
        }
    )


def profile(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One row: rows, entities, date range and null counts per column, from a single aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs.append((F.countDistinct(spec.entity) if spec.entity else F.lit(None).cast("long")).alias("entities"))
    for fn, name in ((F.min, "first_date"), (F.max, "last_date")):
        aggs.append((fn(spec.date).cast("date") if spec.date else F.lit(None).cast("date")).alias(name))
    nulls = F.map_from_arrays(F.array(*[F.lit(x) for x in df.columns]), F.array(*[F.count_if(F.col(x).isNull()) for x in df.columns]))
    return df.agg(*aggs, nulls.alias("null_counts")).select(F.lit(spec.name).alias("table"), "*")


def health(profiles: DataFrame, specs: list[TableSpec], today: Column) -> DataFrame:
    """missing / empty / stale / ok per declared table against its permitted age."""
    spark = profiles.sparkSession
    declared = spark.createDataFrame([(s.name, s.max_age_days) for s in specs], "table string, max_age_days int")
    age = F.datediff(today, F.col("last_date"))
    status = (
        F.when(F.col("rows").isNull(), "missing")
        .when(F.col("rows") == 0, "empty")
        .when(F.col("max_age_days").isNotNull() & (F.col("age_days") > F.col("max_age_days")), "stale")
        .otherwise("ok")
    )
    out = declared.join(profiles.select("table", "rows", "last_date"), "table", "left").withColumn("age_days", age)
    return out.select("table", "rows", "last_date", "age_days", status.alias("status"))


def data_version(profiles: DataFrame) -> DataFrame:
    """Checksum over one line per table (name, rows, date range)."""
    line = F.concat_ws("|", "table", F.col("rows").cast("string"), F.col("first_date").cast("string"), F.col("last_date").cast("string"))
    lines = F.sort_array(F.collect_list(line))  # one per declared table
    return profiles.agg(F.sha2(F.concat_ws("\n", lines), 256).alias("data_version"), F.count(F.lit(1)).alias("tables"))


def raise_on(problems: list[tuple[str, str]], rows: list, name: str) -> None:
    if problems or rows:
        raise ValueError(f"{name}: {problems} {[tuple(r) for r in rows]}")


def check(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Raise unless the frame honours its contract; returns it unchanged. At most a handful of problem rows reach the driver."""
    raise_on(schema_problems(df, spec), [], spec.name)
    raise_on([], validate(df, spec).collect(), spec.name)
    return df


def empty(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return spark.createDataFrame([], spec.schema)


def _table(name, layer, ddl, key, **kw) -> TableSpec:
    return TableSpec(name, layer, ddl, tuple(key.split()), **kw)


# The declared tables.
TABLES = {
    t.name: t
    for t in (
        _table("companies", "curated", "company_id string, cik bigint, name string, sector string, industry string, business_model string", "company_id", entity="company_id"),
        _table("securities", "curated", "company_id string, ticker string, share_class string, is_primary boolean", "company_id ticker", entity="ticker"),
        _table("security_master", "curated", "security_id string, company_id string, current_ticker string, sector string, industry string, price_coverage string, first_date date, last_date date, delisting_date date, delisting_return_status string, price_first date, price_last date, data_quality string, status string", "security_id", entity="security_id", date="last_date"),
        _table("ticker_history", "curated", "security_id string, ticker string, start_date date, end_date date, reason string", "security_id ticker start_date", entity="security_id", date="start_date"),
        _table("corporate_actions", "curated", "security_id string, ticker string, action_type string, ex_date date, ratio double, cash_amount double, action_id string", "action_id", entity="security_id", date="ex_date"),
        _table("universe_membership", "curated", "index_name string, security_id string, ticker string, entry_date date, exit_date date, entry_observed_by date, entry_precision string, exit_precision string, tradable boolean, universe_version string", "index_name security_id entry_observed_by", entity="security_id", date="entry_date", transform=membership_defaults),
        _table("prices", "raw", "ticker string, date date, close_raw double, close_adj double, volume double, dollar_volume double, split_ratio double, dividend double", "ticker date", required=("close_raw", "close_adj"), entity="ticker", date="date", max_age_days=5),
        _table("observations", "raw", "company_id string, tag string, unit string, period_start date, period_end date, filed date, available_at date, value double, accession string", "company_id tag period_end period_start accession", required=("value", "filed"), entity="company_id", date="filed", max_age_days=10),
        _table("fundamentals", "curated", "company_id string, concept string, basis string, value double, period_end date, available_at date, n_sources int, is_derived boolean", "company_id concept basis available_at", required=("value",), entity="company_id", date="available_at", max_age_days=10),
        _table("estimates", "raw", "company_id string, as_of date, metric string, period string, consensus double, low double, high double, growth double, n_analysts int, up_30d int, down_30d int", "company_id as_of metric period", entity="company_id", date="as_of", max_age_days=10),
        _table("earnings_events", "raw", "company_id string, event_date date, estimate double, actual double, surprise double, is_future boolean", "company_id event_date", entity="company_id", date="event_date", transform=lambda df: percent_to_fraction(df, "surprise")),
        _table("metric_scores", "derived", "company_id string, ticker string, date date, metric string, category string, raw_value double, winsorized_value double, percentile double, score double, peer_basis string, peer_group string, peer_count int, peer_median double, is_missing boolean, status string, weight double, spec_version string", "company_id date metric", entity="company_id", date="date", max_age_days=5),
        _table("category_scores", "derived", "company_id string, ticker string, date date, category string, n_metrics int, n_missing int, coverage double, score double, weight double, contribution double", "company_id date category", entity="company_id", date="date", max_age_days=5),
        _table("opportunity_scores", "derived", "company_id string, ticker string, date date, score double, coverage double, rank int, percentile double, universe_size int, band string, confidence double, confidence_label string", "company_id date", entity="company_id", date="date", max_age_days=5),
        _table("valuations", "derived", "company_id string, ticker string, date date, bear double, base double, bull double, upside double, confidence double, classification string", "company_id date", entity="company_id", date="date", max_age_days=5),
        _table("risk", "derived", "company_id string, ticker string, date date, risk_score double, risk_label string, distress_score double, piotroski int, spread_bps double", "company_id date", entity="company_id", date="date", max_age_days=5),
        _table("value_trap", "derived", "company_id string, ticker string, date date, trap_score double, n_fired int, classification string", "company_id date", entity="company_id", date="date"),
        _table("backtest_runs", "artifacts", "run_id string, strategy string, started_at timestamp, params string, result string, status string", "run_id", entity="run_id"),
        _table("backtest_daily", "artifacts", "run_id string, date date, equity double, turnover double, cost double", "run_id date", entity="run_id", date="date"),
        _table("backtest_positions", "artifacts", "run_id string, date date, security_id string, weight double", "run_id date security_id", entity="run_id", date="date"),
        _table("backtest_trades", "artifacts", "run_id string, date date, security_id string, side string, delta_weight double, cost double", "run_id date security_id", entity="run_id", date="date"),
        _table("performance_metrics", "artifacts", "run_id string, benchmark string, metric string, value double", "run_id benchmark metric", entity="run_id"),
        _table("signal_diagnostics", "artifacts", "run_id string, signal string, horizon int, cut string, metric string, value double", "run_id signal horizon cut metric", entity="run_id"),
        _table("robustness_tests", "artifacts", "run_id string, test string, variant string, base double, value double, verdict string", "run_id test variant", entity="run_id"),
        _table("experiments", "artifacts", "trial_id string, recorded_at timestamp, strategy string, period string, params string", "trial_id", entity="trial_id"),
        _table("holdout_audit", "artifacts", "access_id string, accessed_at timestamp, strategy string, reason string", "access_id", entity="access_id"),
    )
}
