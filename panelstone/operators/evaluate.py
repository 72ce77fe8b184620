"""How informative a ranking is: rank correlations, bucket returns, cuts, ablations and persistence.

Ranks come from the value ladder, correlations from map-side-combined moments. Windows run only over tables with one row per
(series, date), which the calendar bounds; ``split=False`` alone sorts the entities of a series and date in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import div, finite
from panelstone.functions.spec import CATEGORY_WEIGHTS
from panelstone.operators.calendar import session_index
from panelstone.operators.ranking import add_rank, average_rank, bucket_of, group_quantiles, key_ladder, keyed
from panelstone.operators.scoring import recompose
from panelstone.session import PART_BYTES, dealt, stacked

MIN_PAIRS = 10


def correlation(x: str, y: str) -> Column:
    """Correlation of complete pairs; null when either side does not vary (the built-in raises on a zero deviation)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman_by(df: DataFrame, keys: list[str], x: str, y: str, min_pairs: int = MIN_PAIRS, name: str = "ic", drop_thin: bool = True, split: bool = True) -> DataFrame:
    """Rank correlation of the finite pairs of each group: ``keys + [name, n]``.

    Groups under ``min_pairs`` are dropped, or kept with a null correlation when ``drop_thin`` is off. Both sides are ranked beside each
    other, so the input is not read again for the ranks of ranks; ``split=False`` is for groups known to be small.
    """
    pairs = df.select(*keys, finite(x).alias("_x"), finite(y).alias("_y")).where("_x is not null and _y is not null")
    if split:
        pairs = keyed(pairs, keys)
        ranks = lambda v, r: key_ladder(pairs, v).select("_key", v, average_rank().alias(r))
        ranked = pairs.join(ranks("_x", "_rx"), ["_key", "_x"]).join(ranks("_y", "_ry"), ["_key", "_y"])
    else:
        ranked = add_rank(add_rank(pairs, keys, "_x", rank="_rx", split=False), keys, "_y", rank="_ry", split=False)
    out = ranked.groupBy(*keys).agg(correlation("_rx", "_ry").alias(name), F.count(F.lit(1)).alias("n"))
    thick = F.col("n") >= min_pairs
    return out.where(thick) if drop_thin else out.withColumn(name, F.when(thick, F.col(name)))


def pearson_by(df: DataFrame, keys: list[str], x: str, y: str, min_pairs: int = MIN_PAIRS, name: str = "pearson") -> DataFrame:
    pairs = df.select(*keys, finite(x).alias("_x"), finite(y).alias("_y")).where("_x is not null and _y is not null")
    out = pairs.groupBy(*keys).agg(correlation("_x", "_y").alias(name), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= min_pairs)


def ic_by_date(df: DataFrame, score: str, target: str, min_names: int = 20, keys: list[str] | None = None, split: bool = True) -> DataFrame:
    return spearman_by(df, [*(keys or []), "date"], score, target, min_names, split=split)


def _blocked(ic: DataFrame, keys: list[str], horizon: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    row = F.row_number().over(order) - 1
    return ic.where(F.col("ic").isNotNull()).withColumn("_block", F.floor(row / F.greatest(horizon, F.lit(1))).cast("int"))


def ic_summary(ic: DataFrame, horizon: int | str, keys: list[str] | None = None) -> DataFrame:
    """Mean, spread, hit rate, and a t-statistic over the means of non-overlapping blocks of ``horizon`` dates.

    The last, partial block counts. ``ic`` has one row per series and date.
    """
    keys = keys or []
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    blocks = _blocked(ic, keys, h).groupBy(*keys, "_block").agg(
        F.avg("ic").alias("_mean"),
        F.sum("ic").alias("_s"),
        F.sum(F.col("ic") * F.col("ic")).alias("_ss"),
        F.count("ic").alias("_n"),
        F.count_if(F.col("ic") > 0).alias("_hits"),
        F.collect_list("ic").alias("_values"),  # at most ``horizon`` values
    )
    n, mean = F.sum("_n"), div(F.sum("_s"), F.sum("_n"))
    var = div(F.sum("_ss") - F.sum("_s") * mean, n - 1)
    std = F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
    sorted_values = F.sort_array(F.flatten(F.collect_list("_values")))  # one value per date: bounded by the calendar
    out = blocks.groupBy(*keys).agg(
        mean.alias("ic_mean"),
        sorted_values.alias("_v"),
        std.alias("ic_std"),
        n.alias("n_dates"),
        F.count(F.lit(1)).alias("n_blocks"),
        div(F.sum("_hits"), n).alias("hit_rate"),
        F.avg("_mean").alias("_bm"),
        F.stddev_samp("_mean").alias("_bs"),
    )
    size = F.size("_v")
    lower, upper = F.get("_v", F.floor((size - 1) / 2).cast("int")), F.get("_v", F.floor(size / 2).cast("int"))
    return out.select(
        *keys,
        "ic_mean",
        ((lower + upper) / 2.0).alias("ic_median"),
        "ic_std",
        F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std")).alias("ic_ir"),
        F.when((F.col("n_blocks") > 2) & (F.col("_bs") > 0), F.col("_bm") / (F.col("_bs") / F.sqrt("n_blocks"))).alias("ic_t"),
        "hit_rate",
        "n_dates",
        "n_blocks",
    )


def melt_signals(df: DataFrame, signals: list[str], targets: dict[str, int], ids: list[str]) -> DataFrame:
    """Long frame of (signal, horizon, x, y) so that every pairing shares one pass."""
    cells = [
        F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon"), F.col(s).cast("double").alias("x"), F.col(t).cast("double").alias("y"))
        for s in signals
        for t, h in targets.items()
    ]
    return df.select(*ids, F.explode(F.array(*cells)).alias("_c")).select(*ids, "_c.*")


def signal_ic(df: DataFrame, signals: list[str], targets: dict[str, int], min_names: int = 20, split: bool = True) -> DataFrame:
    """Information coefficient per (signal, horizon, date).

    ``split=False`` ranks one signal and date in one task, as narrow rows that move once; the parts grow with the files read.
    """
    long, keys = melt_signals(df, signals, targets, ["date"]), ["signal", "horizon"]
    return ic_by_date(long if split else dealt(long, *keys, "date", part_bytes=PART_BYTES // 4), "x", "y", min_names, keys, split)


def signal_summary(df: DataFrame, signals: list[str], targets: dict[str, int], min_names: int = 20, split: bool = True) -> DataFrame:
    return ic_summary(signal_ic(df, signals, targets, min_names, split), "horizon", ["signal", "horizon"])


def with_medians(grouped: DataFrame, df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Attach exact group medians without holding any group in one task."""
    medians = group_quantiles(df, keys, value, linear={name: 0.5}).drop("n")
    return grouped.join(medians, keys, "left")


def bucket_returns(df: DataFrame, score: str, target: str, buckets: int, raw_target: str | None = None) -> DataFrame:
    """Forward returns by within-date score bucket."""
    kept = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    ranked = add_rank(kept, ["date"], score, percentile="_pct").withColumn("bucket", bucket_of(F.col("_pct"), buckets))
    out = ranked.groupBy("bucket").agg(
        F.avg(target).alias("mean_excess"),
        F.stddev_samp(target).alias("std_excess"),
        F.avg(raw_target or target).alias("mean_total"),
        F.avg((F.col(target) > 0).cast("double")).alias("hit_rate"),
        F.avg(score).alias("mean_score"),
        F.count(F.lit(1)).alias("n"),
    )
    return with_medians(out, ranked, ["bucket"], target, "median_excess")


def monotonicity(buckets: DataFrame) -> DataFrame:
    """Rank correlation of bucket number and mean return; null below three buckets or ten points."""
    keyed = buckets.withColumn("_k", F.lit(0))
    out = spearman_by(keyed, ["_k"], "bucket", "mean_excess", MIN_PAIRS, "monotonicity", drop_thin=False, split=False)
    return out.select(F.when(F.col("n") >= 3, F.col("monotonicity")).alias("monotonicity"), F.col("n").alias("n_buckets"))


def spread(buckets: DataFrame) -> DataFrame:
    """Top minus bottom bucket."""
    return buckets.agg(
        F.when(F.count(F.lit(1)) >= 2, F.max_by("mean_excess", "bucket") - F.min_by("mean_excess", "bucket")).alias("spread")
    )


def band_returns(df: DataFrame, target: str, band: str = "band", score: str = "score") -> DataFrame:
    kept = df.where(F.col(band).isNotNull() & F.col(target).isNotNull())
    out = kept.groupBy(band).agg(
        F.avg(target).alias("mean_excess"),
        F.avg((F.col(target) > 0).cast("double")).alias("hit_rate"),
        F.avg(score).alias("mean_score"),
        F.count(F.lit(1)).alias("n"),
    )
    return with_medians(out, kept, [band], target, "median_excess")


def ic_by_group(df: DataFrame, group: str, score: str, target: str, horizon: int, min_dates: int = 12, min_names: int = 10) -> DataFrame:
    """IC inside each group, for groups with enough dates."""
    kept = df.where(F.col(group).isNotNull())
    summary = ic_summary(ic_by_date(kept, score, target, min_names, [group]), horizon, [group])
    observed = kept.groupBy(group).agg(F.count(target).alias("n_obs"))
    return summary.where(F.col("n_dates") >= min_dates).join(observed, group).select(
        F.col(group).alias("group"), "ic_mean", "ic_t", "hit_rate", "n_dates", "n_obs"
    )


def add_size_buckets(df: DataFrame, value: str = "market_cap", buckets: int = 5, name: str = "size_bucket") -> DataFrame:
    out = add_rank(df, ["date"], value, percentile="_pct")
    number = bucket_of(F.col("_pct"), buckets) + 1
    label = F.when(number == 1, "1 smallest").when(number == buckets, F.lit(f"{buckets} largest")).otherwise(number.cast("string"))
    return out.withColumn(name, F.when(F.col("_pct").isNotNull(), label)).drop("_pct")


def add_calendar_year(df: DataFrame) -> DataFrame:
    return df.withColumn("calendar_year", F.year("date").cast("string"))


def expanding_bands(df: DataFrame, value: str, low: float = 0.33, high: float = 0.67, min_n: int = 10) -> DataFrame:
    """Quantile bands that only see the past; null until ``min_n`` finite observations exist. One row per date."""
    seen = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = finite(value)
    ready = F.count(x).over(seen) >= min_n
    return df.withColumns(
        {
            f"{value}_low": F.when(ready, F.percentile(x, F.lit(low)).over(seen)),
            f"{value}_high": F.when(ready, F.percentile(x, F.lit(high)).over(seen)),
        }
    )


def classify_regimes(market: DataFrame, decisions: DataFrame, yields: DataFrame | None = None) -> DataFrame:
    """Trend, volatility and rate regime on each decision date from one benchmark's ``date, close_adj``.

    Every window here runs over one row per session.
    """
    w = Window.orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    span = lambda n: w.rowsBetween(-(n - 1), 0)
    full = lambda x, n, agg: F.when(F.count(x).over(span(n)) == n, agg(x).over(span(n)))
    m = market.select("date", "close_adj").withColumn("ret", div("close_adj", F.lag("close_adj", 1).over(w)) - 1.0)
    m = m.withColumns(
        {
            "ma200": full("close_adj", 200, F.avg),
            "vol63": full("ret", 63, F.stddev_samp),
            "from_peak": div("close_adj", F.max("close_adj").over(upto)) - 1.0,
        }
    ).withColumn("slope", div("ma200", F.lag("ma200", 63).over(w)) - 1.0)
    at = expanding_bands(m.join(F.broadcast(decisions.select("date")), "date", "left_semi"), "vol63")
    trend = (
        F.when(F.col("from_peak") <= -0.10, "bear")
        .when((F.col("close_adj") > F.col("ma200")) & (F.col("slope") > 0), "bull")
        .otherwise("neutral")
    )
    out = at.withColumns({"trend_regime": trend, "volatility_regime": _thirds("vol63", "volatility")})
    if yields is None:
        out = out.withColumns({"yield_10y": F.lit(None).cast("double"), "rate_regime": F.lit(None).cast("string")})
    else:
        from panelstone.operators.asof import asof_backward

        out = asof_backward(out, yields, [], "date", "date", {"value": "yield_10y"})
        out = expanding_bands(out, "yield_10y").withColumn("rate_regime", _thirds("yield_10y", "rate"))
    return out.select("date", "trend_regime", "volatility_regime", "rate_regime", "yield_10y", "from_peak", "vol63")


def _thirds(value: str, noun: str) -> Column:
    return (
        F.when(F.col(value) >= F.col(f"{value}_high"), f"high_{noun}")
        .when(F.col(value) <= F.col(f"{value}_low"), f"low_{noun}")
        .otherwise(f"mid_{noun}")
    )


def ablations(df: DataFrame, target: str, horizon: int, weights: dict[str, float] = CATEGORY_WEIGHTS) -> DataFrame:
    """IC of the composite as stored and rebuilt without each category; all variants in one pass.

    Cut groups would move the rows of every variant a dozen times; here each moves once and a task sorts the companies of a date, as
    in the scoring before it.
    """
    names = {"nothing": "score"}
    for category in weights:
        df = recompose(df, weights, drop=category, name=f"_without_{category}")
        names[category] = f"_without_{category}"
    summary = signal_summary(df, list(names.values()), {target: horizon}, split=False)
    back = reduce(
        lambda acc, kv: acc.when(F.col("signal") == kv[1], F.lit(kv[0])), names.items(), F.when(F.lit(False), F.lit(""))
    )
    labelled = summary.withColumn("removed", back)
    base = labelled.where(F.col("removed") == "nothing").select(F.col("ic_mean").alias("_base"))
    return labelled.join(F.broadcast(base)).select(  # one row
        "removed", "ic_mean", "ic_t", (F.col("ic_mean") - F.col("_base")).alias("delta_ic"), "hit_rate", "n_dates"
    )


def score_persistence(df: DataFrame, entity: str, score: str, min_common: int = 20) -> DataFrame:
    """Mean rank correlation between each date's scores and the next date's."""
    idx = F.broadcast(session_index(df.select("date").distinct()))  # one row per decision date
    now = df.select(entity, "date", F.col(score).alias("_now")).join(idx, "date")
    before = now.select(entity, (F.col("idx") + 1).alias("idx"), F.col("_now").alias("_before"))
    both = now.join(before, [entity, "idx"])
    sizes = both.groupBy("idx").agg(F.count(F.lit(1)).alias("_common"))
    ic = spearman_by(both, ["idx"], "_before", "_now").join(sizes.where(F.col("_common") >= min_common), "idx")
    return ic.agg(F.avg("ic").alias("autocorrelation"), F.count("ic").alias("n_pairs"))


def ic_decay(df: DataFrame, entity: str, score: str, price: str, horizons: list[int], min_names: int = 20) -> DataFrame:
    """IC against forward returns of several row horizons."""
    w = Window.partitionBy(entity).orderBy("date")
    ahead = df.withColumns({f"_f{h}": div(F.lead(price, h).over(w), price) - 1.0 for h in horizons})
    return signal_summary(ahead, [score], {f"_f{h}": h for h in horizons}, min_names)


def correlation_pairs(df: DataFrame, columns: list[str], min_rows: int = 100) -> DataFrame:
    """Correlation of every pair of columns over complete rows; one aggregate, one output row per pair."""
    whole = df.select(*[finite(x).alias(x) for x in columns]).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = whole.agg(F.count(F.lit(1)).alias("n"), *[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return wide.where(F.col("n") >= min_rows).select("n", F.explode(cells).alias("_c")).select("_c.*", "n")


def feature_ic(df: DataFrame, features: list[str], target: str, min_names: int = 20) -> DataFrame:
    """IC per feature and date together with the share of rows on which the feature was observed."""
    ic = signal_ic(df, features, {target: 1}, min_names)
    coverage = df.groupBy("date").agg(*[(F.count(x) / F.count(F.lit(1))).alias(x) for x in features])
    coverage = coverage.unpivot(["date"], features, "signal", "coverage")
    return ic.join(coverage, ["signal", "date"]).select("signal", "date", "ic", "n", "coverage")


def fit_weights(ic: DataFrame, cutoff: Column, block: int, min_obs: int = 250, min_t: float = 2.0) -> DataFrame:
    """Signed weights per signal from ICs up to a cut-off; unproven signals get zero, the gross sums to one."""
    seen = ic.where(F.col("date") <= cutoff)
    stats = ic_summary(seen, block, ["signal"])
    proven = (F.abs("ic_t") >= min_t) & (F.col("n_dates") >= min_obs)
    raw = F.coalesce(F.when(proven, F.col("ic_mean")), F.lit(0.0))
    stats = stats.withColumn("_raw", raw)
    gross = stats.agg(F.sum(F.abs("_raw")).alias("_gross"))
    return stats.join(F.broadcast(gross)).select(  # one row
        "signal", F.when(F.col("_gross") > 0, F.col("_raw") / F.col("_gross")).otherwise(0.0).alias("weight"), "ic_mean", "ic_t", "n_dates"
    )


def make_folds(dates: DataFrame, first_train: int, test: int, purge: int) -> DataFrame:
    """Expanding walk-forward folds over a date index: train [0, a), a purged gap, test [a + purge, a + purge + test)."""
    idx = session_index(dates)
    n = idx.agg(F.count(F.lit(1)).alias("_n"))
    starts = n.where(F.col("_n") > first_train + purge).select(
        "_n", F.explode(F.sequence(F.lit(first_train), F.col("_n") - purge - 1, F.lit(test))).alias("train_end")
    )
    folds = starts.select(
        F.floor((F.col("train_end") - first_train) / test).cast("int").alias("fold"),
        "train_end",
        (F.col("train_end") + purge).alias("test_start"),
        F.least(F.col("train_end") + purge + test, F.col("_n")).alias("test_end"),
    )
    lookup = F.broadcast(idx)  # one row per session
    at = lambda name: lookup.select(F.col("idx").alias(name), F.col("date").alias(f"{name}_date"))
    return (
        folds.withColumns({"last_train": F.col("train_end") - 1, "last_test": F.col("test_end") - 1})
        .join(at("last_train"), "last_train")
        .join(at("test_start"), "test_start")
        .join(at("last_test"), "last_test")
        .select("fold", "train_end", "test_start", "test_end", "last_train_date", "test_start_date", "last_test_date")
    )


def leaking_folds(folds: DataFrame) -> DataFrame:
    """Folds whose training data reaches into the test span (must be empty)."""
    return folds.where(F.col("last_train_date") >= F.col("test_start_date"))


def rotate_within(df: DataFrame, keys: list[str], order: Column, value: str, name: str, piece: Column | None = None) -> DataFrame:
    """Hand every row the value of its predecessor in ``order`` (the first gets the last): a permutation inside each group.

    ``piece`` must not fall as ``order`` rises. A group is then sorted piece by piece, and the first row of a piece takes the last value
    of the piece before it, so the result is the same however a group is cut. ``value`` must not be null.
    """
    rows = df.withColumns({"_order": order, "_piece": F.lit(0) if piece is None else piece})
    w = Window.partitionBy(*keys, "_piece").orderBy("_order")
    out = rows.withColumn(name, F.lag(value, 1).over(w))
    ends = rows.groupBy(*keys, "_piece").agg(F.max_by(value, "_order").alias("_end"))
    p = Window.partitionBy(*keys).orderBy("_piece")
    last = F.last("_end").over(p.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = ends.select(*keys, "_piece", F.coalesce(F.lag("_end", 1).over(p), last).alias("_before"))
    return out.join(before, [*keys, "_piece"]).withColumn(name, F.coalesce(name, "_before")).drop("_piece", "_order", "_before")


def leakage_audit(df: DataFrame, entity: str, score: str, target: str, lag: int, seed: int, min_names: int = 3, digits: int = 2) -> DataFrame:
    """Mean IC of the prediction as is, lagged, against an earlier target, and with targets shuffled or moved between entities.

    The shuffle orders rows by a seeded hash, so a recomputed task repeats it; a date is cut by the first ``digits`` hexadecimal digits of
    that hash, which changes nothing in the result. The move between entities sorts the entities of a date in one task.
    """
    known = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    base = known.select(F.col(entity).alias("entity"), "date", F.col(score).alias("x"), F.col(target).alias("y"))
    w = Window.partitionBy("entity").orderBy("date")
    tag = lambda d, v, x, y: d.select("date", F.lit(v).alias("variant"), F.col(x).alias("x"), F.col(y).alias("y"))
    earlier = base.withColumns({"_x": F.lag("x", lag).over(w), "_y": F.lag("y", lag).over(w)})
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "entity", F.col("date").cast("string")))
    noise = rotate_within(base, ["date"], mark, "y", "_y", F.substring(mark, 1, digits))
    moved = rotate_within(base, ["date"], F.col("entity"), "y", "_y")
    every = [
        tag(base, "as_is", "x", "y"), tag(earlier, "lagged_score", "_x", "y"), tag(earlier, "earlier_target", "x", "_y"),
        tag(noise, "shuffled", "x", "_y"), tag(moved, "entity_moved", "x", "_y"),
    ]
    ic = ic_by_date(reduce(stacked, every), "x", "y", min_names, ["variant"])
    return ic.groupBy("variant").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n_dates"))


def time_split(df: DataFrame, fraction: float) -> DataFrame:
    """Tag rows train/test by the position of their date among the distinct dates."""
    idx = session_index(df.select("date").distinct())
    n = idx.agg(F.count(F.lit(1)).alias("_n"))
    cut = idx.join(F.broadcast(n)).select("date", F.when(F.col("idx") < F.floor(F.col("_n") * fraction), "train").otherwise("test").alias("split"))
    return df.join(F.broadcast(cut), "date")  # one row per date
