"""The record of what was run: runs keyed by their content, results replaced by key, trials and holdout accesses recorded once for ever."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstone.session import stacked
from panelstone.sources.contracts import TABLES, TableSpec, check, coerce
from panelstone.sources.tables import append, read, recorded, upsert

# Tables whose rows a repeated run replaces by key, and tables that only ever grow.
RESULTS = (
    "backtest_runs", "backtest_daily", "backtest_positions", "backtest_trades", "performance_metrics", "signal_diagnostics", "robustness_tests",
)
PERMANENT = ("experiments", "holdout_audit")


def content_id(prefix: str, *parts: Column | str) -> Column:
    """Identity of a record by what defines it: equal content has equal ids in any session. Null parts count, and differ from empty ones."""
    cells = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.to_json(F.struct(*[c.cast("string").alias(f"p{i}") for i, c in enumerate(cells)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, 32))


def save_results(records: dict[str, DataFrame], root: str) -> None:
    """Store result rows by table name; rows of a run saved before are replaced by key, so saving twice changes nothing."""
    unknown = set(records) - set(RESULTS)
    if unknown:
        raise ValueError(f"not a result table: {sorted(unknown)}")
    for name, df in records.items():
        upsert(df, root, name)


def record(df: DataFrame, root: str, name: str) -> int:
    """Add the records whose key is new and return how many; a repeated one changes nothing.

    Permanent tables take no second opinion: a known key with other content (times aside) is an error and nothing is added.
    """
    if name not in PERMANENT:
        raise ValueError(f"not a permanent table: {name}")
    spec, spark = TABLES[name], df.sparkSession
    incoming = coerce(df, spec)
    known = read(spark, root, spec)
    if known is not None:
        other = _changed(incoming, known, spec)
        if not other.isEmpty():
            raise ValueError(f"{name}: recorded already with other content: {[r[0] for r in other.limit(3).collect()]}")
        incoming = incoming.join(recorded(known, spec), list(spec.key), "left_anti")
    added = incoming.count()
    if added:
        append(check(incoming, spec), root, spec)
    return added


def _changed(incoming: DataFrame, known: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys on both sides whose content differs; the time of recording is no content."""
    content = [f.name for f in spec.schema if f.name not in spec.key and f.dataType.typeName() != "timestamp"]
    mine = incoming.select(*spec.key, F.struct(*content).alias("_mine"))
    theirs = known.select(*spec.key, F.struct(*content).alias("_theirs"))
    return mine.join(theirs.hint("merge"), list(spec.key)).where(~F.col("_mine").eqNullSafe(F.col("_theirs"))).select(*spec.key)


def trials_by_strategy(spark: SparkSession, root: str) -> DataFrame:
    """``strategy, n_trials, n_holdout`` of every strategy with a recorded trial or holdout access."""
    parts = []
    for name, trial in (("experiments", 1), ("holdout_audit", 0)):
        known = read(spark, root, name)
        if known is not None:
            parts.append(known.groupBy("strategy").agg((F.count(F.lit(1)) * trial).alias("n_trials"), (F.count(F.lit(1)) * (1 - trial)).alias("n_holdout")))
    if not parts:
        return spark.createDataFrame([], "strategy string, n_trials bigint, n_holdout bigint")
    both = parts[0] if len(parts) == 1 else parts[0].transform(stacked, parts[1])
    return both.groupBy("strategy").agg(F.sum("n_trials").alias("n_trials"), F.sum("n_holdout").alias("n_holdout"))
