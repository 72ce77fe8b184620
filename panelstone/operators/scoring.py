"""Peer-relative scoring: metric percentiles with fallback groups, category blends, and the composite."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import banded, div, mapped
from panelstone.functions.spec import (
    CATEGORY_WEIGHTS,
    METRICS,
    MIN_CATEGORY_COVERAGE,
    MIN_TOTAL_COVERAGE,
    NOT_SCORED,
    PEER_CHAIN,
    SCORE_BANDS,
    SPEC_VERSION,
    Metric,
)
from panelstone.operators.asof import lag_asof
from panelstone.operators.ranking import (
    add_ordinal_rank,
    add_rank,
    annotate,
    average_rank,
    holds,
    linear_quantile,
    nearest_index,
    order_statistic,
)
from panelstone.session import PART_BYTES, cut_lineage, dealt, parts_of

ROW = ["company_id", "ticker", "date"]


def stable(x: Column) -> Column:
    """Drop the last digits of a distributed sum, so that scores equal on paper tie whatever the order of addition."""
    return F.round(x, 9)


def score_band(score) -> Column:
    return banded(score, SCORE_BANDS, "Very unattractive", NOT_SCORED)


def add_peer_keys(panel: DataFrame) -> DataFrame:
    """Grouping keys for each peer basis; the size decile ranks market cap by (value, ticker) within the date."""
    sector = F.coalesce("sector", F.lit("Unclassified"))
    industry = F.coalesce("industry", F.lit("Unclassified"))
    out = panel.withColumns(
        {"peer_universe": F.lit("all"), "peer_sector": sector, "peer_industry": F.concat(sector, F.lit(" / "), industry)}
    )
    if "market_cap" not in panel.columns:
        return out.withColumn("peer_size_decile", F.lit("1"))
    sizes = panel.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    out = add_ordinal_rank(out, ["date"], "market_cap", "company_id", "_size_rank").join(sizes, "date", "left")
    decile = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("_size_rank") / F.col("_rows") * 10)))
    return out.withColumn(
        "peer_size_decile", F.when(F.col("_size_rank").isNotNull(), decile.cast("int").cast("string"))
    ).drop("_size_rank", "_rows")


def melt_metrics(panel: DataFrame, metrics: tuple[Metric, ...]) -> DataFrame:
    """Long frame of raw and usable values, one row per company, date and metric; a metric travels as its number."""
    cells = [
        F.struct(
            F.lit(i).alias("m"),
            F.coalesce(F.col("business_model").isin(list(m.models)), F.lit(False)).alias("applies"),
            F.col(m.key).cast("double").alias("raw_value"),
        )
        for i, m in enumerate(metrics)
    ]
    peers = [x for x in ("peer_industry", "peer_sector", "peer_size_decile", "peer_universe") if x in panel.columns]
    long = panel.select(*ROW, *peers, F.explode(F.array(*cells)).alias("_m")).select(*ROW, *peers, "_m.*")
    return long.withColumn("usable_value", F.when(F.col("applies"), F.col("raw_value")))


def _spec(metrics: tuple[Metric, ...], attribute: str) -> Column:
    """A declared attribute of the row's metric: a constant when all share it, else a lookup by number."""
    values = [getattr(m, attribute) for m in metrics]
    distinct = list(dict.fromkeys(values))
    if len(distinct) == 1:
        return F.lit(distinct[0])
    if len(distinct) <= 3:
        out = F.lit(distinct[0])
        for value in distinct[1:]:
            out = F.when(F.col("m").isin([i for i, v in enumerate(values) if v == value]), F.lit(value)).otherwise(out)
        return out
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("m"))


def _percentiles(df: DataFrame, keys: list[str], metrics: tuple[Metric, ...], split: bool) -> DataFrame:
    """Add ``_n, _pct, _win, _mid`` of the peer group given by ``keys``.

    Ranks of winsorised values follow from the tie counts at the two limits, so values are sorted once.
    """
    winsor = _spec(metrics, "winsor")
    lo, hi = nearest_index(winsor), nearest_index(1.0 - winsor)
    median, middle = linear_quantile(0.5, "usable_value", "med")
    stats = {
        "_lo": order_statistic(lo, "usable_value"),
        "_hi": order_statistic(hi, "usable_value"),
        "_upto_lo": F.max(F.when(holds(lo), F.col("n_below") + F.col("n_eq"))),
        "_below_hi": F.max(F.when(holds(hi), F.col("n_below"))),
        **median,
    }
    ranked = annotate(df, keys, "usable_value", stats, split=split)
    v, n = F.col("usable_value"), F.col("n_group")
    rank = (
        F.when(F.col("_lo") == F.col("_hi"), (n + 1) / 2.0)
        .when(v <= F.col("_lo"), (F.col("_upto_lo") + 1) / 2.0)
        .when(v >= F.col("_hi"), (F.col("_below_hi") + n + 1) / 2.0)
        .otherwise(average_rank())
    )
    pct = F.try_divide(rank - 0.5, n)
    pct = F.when(_spec(metrics, "direction") < 0, 1.0 - pct).otherwise(pct)
    return ranked.withColumns(
        {
            "_n": n.cast("int"),
            "_pct": F.when(v.isNotNull() & (n >= 2), pct),
            "_win": F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_hi")), F.col("_lo"))),
            "_mid": middle,
        }
    ).drop("n_below", "n_eq", "n_group", *stats)


def _dealt_in_turn(panel: DataFrame, metrics: tuple[Metric, ...]) -> DataFrame:
    """``melt_metrics`` with each metric's dates dealt to the parts in turn; ``_part`` follows from metric and date.

    These groups are few and grow with the input: parts by hash would get several of them by chance, and adaptive execution joins parts
    by their size before the windows widen them. The number of parts grows with the files read.
    """
    numbers = panel.select(F.col("date").alias("_date")).distinct()
    turn = (F.row_number().over(Window.orderBy("_date")) - 1) * len(metrics)  # one row per date
    numbers = F.broadcast(numbers.withColumn("_turn", turn))
    long = melt_metrics(panel, metrics)
    long = long.join(numbers, F.col("date").eqNullSafe(F.col("_date"))).withColumn("_part", F.col("_turn") + F.col("m"))
    # What follows from other columns does not travel. A panel row becomes a row for each metric, so parts are small.
    moved = long.drop("_date", "_turn", "m", "usable_value").repartitionById(parts_of(panel, PART_BYTES // 4), "_part")
    return moved.withColumns({"m": F.col("_part") % len(metrics), "usable_value": F.when(F.col("applies"), F.col("raw_value"))})


#: What a row takes from the peer group that was chosen for it.
CHOSEN = ("basis", "peer", "n", "pct", "win", "mid")


def _chosen_in_place(panel: DataFrame, metrics: tuple[Metric, ...], levels: list[str]) -> DataFrame:
    """Every level side by side on one row. All levels contain (metric, date), so one shuffle serves all their windows.

    Each field of a level is a column of its own: what nobody reads is neither computed nor carried through the sorts.
    """
    out = _dealt_in_turn(panel, metrics)
    for level in levels:
        keys = ["_part", "m", "date"] if level == "universe" else ["_part", "m", "date", f"peer_{level}"]
        out = _percentiles(out, keys, metrics, split=False)
        out = out.withColumnsRenamed({f"_{f}": f"_{f}_{level}" for f in ("n", "pct", "win", "mid")})
    field = lambda level, f: F.lit(level) if f == "basis" else F.col(f"peer_{level}" if f == "peer" else f"_{f}_{level}")
    picked, broadest = {}, {}
    for basis, chain in PEER_CHAIN.items():
        steps = [x for x in chain if x in levels]
        if len(steps) < len(chain):
            continue
        here = _spec(metrics, "basis") == basis
        enough = {x: F.col(f"_n_{x}") >= _spec(metrics, "min_peers") for x in steps}
        for f in CHOSEN:
            choice = reduce(lambda c, x: (F if c is None else c).when(enough[x], field(x, f)), steps, None)  # noqa: B023
            picked[f] = picked.get(f, F).when(here, choice)
            broadest[f] = broadest.get(f, F).when(here, field(steps[-1], f))
    made = {f"_g_{f}": c for f, c in picked.items()} | {f"_b_{f}": broadest[f] for f in ("basis", "peer")}
    return out.withColumns(made).drop(*[f"_{f}_{x}" for x in levels for f in ("n", "pct", "win", "mid")])


def _chosen_by_level(long: DataFrame, metrics: tuple[Metric, ...], levels: list[str]) -> DataFrame:
    """One row per level, ranked with the split plan and brought together again: no task needs a whole date."""
    basis = _spec(metrics, "basis")
    chains = None
    for name, chain in PEER_CHAIN.items():
        if not set(chain) <= set(levels):
            continue
        cells = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(x).alias("basis"), F.col(f"peer_{x}").alias("peer")) for i, x in enumerate(chain)])
        chains = F.when(basis == name, cells) if chains is None else chains.when(basis == name, cells)
    levelled = long.withColumn("_l", F.explode(chains)).select("*", "_l.*").drop("_l")
    ranked = _percentiles(levelled, ["m", "date", "basis", "peer"], metrics, split=True)
    enough = F.col("_n") >= _spec(metrics, "min_peers")
    found = F.struct("basis", "peer", F.col("_n").alias("n"), F.col("_pct").alias("pct"), F.col("_win").alias("win"), F.col("_mid").alias("mid"))
    carried = ["applies", "raw_value"]
    best = ranked.groupBy(*ROW, "m", *carried).agg(
        F.min_by(F.when(enough, found), F.when(enough, F.col("level"))).alias("_g"), F.max_by(found, "level").alias("_b")
    )
    return best.withColumns({f"_g_{f}": F.col(f"_g.{f}") for f in CHOSEN} | {f"_b_{f}": F.col(f"_b.{f}") for f in ("basis", "peer")})


def score_metrics(panel: DataFrame, metrics: tuple[Metric, ...] = METRICS, split: bool = False) -> DataFrame:
    """Percentile of every metric within the finest peer group that is large enough, per date.

    All peer groups of a metric on a date meet in one task: as many rows as the date has companies, whatever the length of the history.
    ``split`` ranks by cut groups instead, for dates with more companies than a task should sort.
    """
    used = tuple(m for m in metrics if m.key in panel.columns)
    if not used:
        raise ValueError("the panel carries none of the declared metrics")
    wanted = {x for m in used for x in PEER_CHAIN[m.basis]}
    levels = [x for x in ("industry", "sector", "size_decile", "universe") if x in wanted]
    best = _chosen_by_level(melt_metrics(panel, used), used, levels) if split else _chosen_in_place(panel, used, levels)
    status = (
        F.when(~F.col("applies"), "not_applicable")
        .when(F.col("raw_value").isNull(), "missing")
        .when(F.col("_g_pct").isNull(), "thin_peers")
        .otherwise("scored")
    )
    return best.select(
        *ROW,
        _spec(used, "key").alias("metric"),
        _spec(used, "category").alias("category"),
        "raw_value",
        F.col("_g_win").alias("winsorized_value"),
        F.col("_g_pct").alias("percentile"),
        (F.col("_g_pct") * 100.0).alias("score"),
        F.coalesce("_g_basis", "_b_basis").alias("peer_basis"),
        F.coalesce("_g_peer", "_b_peer").alias("peer_group"),
        F.col("_g_n").alias("peer_count"),
        F.col("_g_mid").alias("peer_median"),
        (status != "scored").alias("is_missing"),
        status.alias("status"),
        _spec(used, "weight").alias("weight"),
    )


def build_metric_scores(panel: DataFrame, metrics: tuple[Metric, ...] = METRICS) -> DataFrame:
    return score_metrics(add_peer_keys(panel), metrics).withColumn("spec_version", F.lit(SPEC_VERSION))


def build_category_scores(metric_scores: DataFrame, weights: dict[str, float] = CATEGORY_WEIGHTS, floor: float = MIN_CATEGORY_COVERAGE, part_bytes: int | None = None) -> DataFrame:
    """Weighted mean of observed metrics; declined when too little of the applicable weight was observed.

    Rows are dealt by company and date, so that a composite of the categories needs no other shuffle; ``part_bytes`` of the files read make
    a part.
    """
    seen = F.col("seen")
    narrow = metric_scores.where(F.col("status") != "not_applicable").select(*ROW, "category", "score", "weight", (F.col("status") == "scored").alias("seen"))
    out = (
        dealt(narrow, *ROW, part_bytes=part_bytes)
        .groupBy(*ROW, "category")
        .agg(
            F.sum(F.when(seen, F.col("score") * F.col("weight")).otherwise(0.0)).alias("_sum"),
            F.sum(F.when(seen, F.col("weight")).otherwise(0.0)).alias("_observed"),
            F.sum("weight").alias("_applicable"),
            F.count(F.lit(1)).cast("int").alias("n_metrics"),
            F.count_if(~seen).cast("int").alias("n_missing"),
        )
        .withColumn("coverage", div("_observed", "_applicable"))
    )
    # Sums of declared weights differ in their last digits with the order of addition: compare with a margin.
    enough = (F.col("coverage") >= floor - 1e-12) & (F.col("_observed") > 0)
    return (
        out.withColumn("score", stable(F.when(enough, div("_sum", "_observed"))))
        .withColumn("weight", mapped("category", weights, 0.0))
        .withColumn("contribution", F.col("score") * F.col("weight"))
        .drop("_sum", "_observed", "_applicable")
    )


def build_opportunity_scores(category_scores: DataFrame, floor: float = MIN_TOTAL_COVERAGE, categories=tuple(CATEGORY_WEIGHTS)) -> DataFrame:
    """One 0-100 composite with rank, percentile, universe size, band and recent changes."""
    has = F.col("score").isNotNull()
    out = category_scores.groupBy(*ROW).agg(
        F.sum(F.when(has, F.col("contribution"))).alias("_c"),
        F.sum(F.when(has, F.col("weight"))).alias("coverage"),
        *[F.max(F.when(F.col("category") == x, F.col("score"))).alias(x) for x in categories],
    ).where(F.col("coverage").isNotNull())
    enough = (F.col("coverage") > 0) & (F.col("coverage") >= floor - 1e-12)
    out = out.withColumn("score", stable(F.when(enough, div("_c", "coverage")))).drop("_c")
    # The composite feeds ranks, sizes and lags: keep it as a table rather than repeating the scoring three times.
    return add_score_changes(cut_lineage(rank_scores(cut_lineage(out))))


def rank_scores(scores: DataFrame, score: str = "score") -> DataFrame:
    """Ordinal rank (best first, ties by company), average-rank percentile, universe size and band, per date."""
    sizes = scores.groupBy("date").agg(F.count(F.lit(1)).cast("int").alias("universe_size"))
    # Only what is ranked moves from step to step; the other columns meet it once.
    row = F.struct("company_id", "date")
    out = add_ordinal_rank(scores.select("company_id", "date", score), ["date"], score, "company_id", "rank", descending=True)
    out = add_rank(out, ["date"], score, percentile="percentile").withColumn("rank", F.col("rank").cast("int"))
    ranks = out.select(row.alias("_id"), "rank", "percentile")
    out = scores.withColumn("_id", row).join(ranks, "_id", "left").drop("_id")
    return out.join(sizes, "date", "left").withColumn("band", score_band(score)).select(
        *scores.columns, "rank", "percentile", "universe_size", "band"
    )


def add_score_changes(scores: DataFrame) -> DataFrame:
    """Score minus the score as of 7 and 30 days earlier."""
    out = lag_asof(scores, ["company_id"], "date", ["score"], {"_1w": 7, "_1m": 30})
    return out.withColumns(
        {"score_change_1w": F.col("score") - F.col("score_1w"), "score_change_1m": F.col("score") - F.col("score_1m")}
    ).drop("score_1w", "score_1m")


def explain(metric_scores: DataFrame, category_scores: DataFrame) -> DataFrame:
    """Stored arithmetic behind each category score: its metrics as an ordered array of structs."""
    item = F.struct("status", (-F.col("weight")).alias("neg_weight"), "metric", "raw_value", "score", "weight", "peer_basis", "peer_count")
    parts = metric_scores.groupBy(*ROW, "category").agg(F.sort_array(F.collect_list(item)).alias("metrics"))
    return category_scores.join(parts, [*ROW, "category"], "left")


def recompose(scores: DataFrame, weights: dict[str, float] = CATEGORY_WEIGHTS, drop: str | None = None, name: str = "score") -> DataFrame:
    """Renormalised weighted mean of the categories present, optionally without one of them."""
    used = {k: w for k, w in weights.items() if k != drop}
    num = reduce(add, [F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in used.items()])
    den = reduce(add, [F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in used.items()])
    return scores.withColumn(name, div(num, den))


def top_reasons(metric_scores: DataFrame) -> DataFrame:
    """The metric that lifts and the metric that drags each company most, by (score - 50) x weight."""
    pull = stable((F.col("score") - 50.0) * F.col("weight"))
    scored = metric_scores.where(F.col("status") == "scored").withColumn("_pull", pull)
    return scored.groupBy(*ROW).agg(
        F.max_by("metric", F.struct("_pull", "metric")).alias("best_metric"),
        F.max("_pull").alias("best_pull"),
        F.min_by("metric", F.struct("_pull", "metric")).alias("worst_metric"),
        F.min("_pull").alias("worst_pull"),
    )
