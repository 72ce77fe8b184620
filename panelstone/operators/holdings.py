"""What became of every holding of a rebalanced portfolio, for any number of runs (parameter rows) in one plan.

A run follows a *plan* (when its decisions are taken and executed); runs that share a plan share its price windows. Prices are reduced
once per (plan, entity, period), combined map-side, and every later step is an equi-join or an aggregate on keys that carry the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstone.operators.calendar import session_index
from panelstone.session import cut_lineage, stacked

BOUGHT = ("held", "liquidated", "written_off")


def schedule(decisions: DataFrame, dates: DataFrame, plans: list[tuple[str, int, int]], tolerance: int = 0) -> DataFrame:
    """When each plan decides and trades: ``plan, period, date, exec_date, next_date, days``.

    ``plans`` are declared (name, offset, delay) triples. A decision date is moved by ``offset`` sessions, reads the latest scores known on
    that session (``date``, one of ``decisions``), and is executed ``delay`` sessions later. ``days`` maps the sessions from one execution
    up to the next to their distance from it; after the last execution it reaches ``tolerance`` sessions. Decisions that leave the calendar,
    fall before the first scores or are no session are dropped. One row per plan and rebalance: bounded by the calendar.
    """
    idx = session_index(dates)
    dec = idx.join(decisions.select("date").distinct(), "date").select("idx", F.col("date").alias("_decided"))
    upto = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)  # one row per session
    known = idx.join(dec, "idx", "left").select("idx", F.last("_decided", ignorenulls=True).over(upto).alias("_scores"))
    cells = F.array(*[F.struct(F.lit(p).alias("plan"), F.lit(o).alias("_o"), F.lit(d).alias("_d")) for p, o, d in plans])
    moved = dec.select("idx", F.explode(cells).alias("_c")).select("_c.plan", (F.col("idx") + F.col("_c._o")).alias("idx"), "_c._d")
    placed = moved.join(known, "idx").where(F.col("_scores").isNotNull()).select("plan", F.col("_scores").alias("date"), (F.col("idx") + F.col("_d")).alias("idx"))
    placed = placed.join(idx.select("idx", F.col("date").alias("exec_date")), "idx")
    order = Window.partitionBy("plan").orderBy("idx")
    out = placed.withColumns(
        {"period": F.row_number().over(order), "next_date": F.lead("exec_date").over(order), "_next": F.lead("idx").over(order)}
    )
    span = F.sequence("idx", F.coalesce(F.col("_next") - 1, F.col("idx") + tolerance))
    return out.select("plan", "period", "date", "exec_date", "next_date", "idx", span.alias("days"))


def price_windows(prices: DataFrame, dates: DataFrame, plan: DataFrame, tolerance: int, entity: str, asked: DataFrame) -> DataFrame:
    """First price within ``tolerance`` sessions of an execution and last price before the next, per plan, entity and period.

    ``asked``: ``plan, entity, period``, unique. Its sessions are looked up among the prices by entity and date, so what moves grows with
    the prices of the names asked for and with their sessions, not with all names times plans.
    """
    idx = session_index(dates)
    spread = plan.select("plan", "period", F.col("idx").alias("_start"), F.explode("days").alias("idx"))
    days = spread.join(idx, "idx").select("date", "plan", "period", (F.col("idx") - F.col("_start")).alias("_gap"))
    usable = prices.where((F.col("close_adj") > 0) & ~F.isnan("close_adj")).select(entity, "date", F.col("close_adj").alias("_p"))
    near = F.when(F.col("_gap") <= tolerance, F.col("date"))
    usable = usable.join(asked.select(entity).distinct(), entity, "left_semi")
    # Days are one row per session and plan: a few thousand, whatever the number of entities.
    return usable.join(asked.join(F.broadcast(days), ["plan", "period"]), [entity, "date"]).groupBy("plan", entity, "period").agg(
        F.min(near).alias("first_date"), F.min_by("_p", near).alias("first_price"),
        F.max("date").alias("last_date"), F.max_by("_p", "date").alias("last_price"),
    )


def outcomes(weights: DataFrame, prices: DataFrame, dates: DataFrame, plan: DataFrame, tolerance: int = 0, entity: str = "ticker") -> DataFrame:
    """Fate and return of every target weight (``run, plan, period, entity, weight``; keys unique).

    * ``not_bought``: no price within ``tolerance`` sessions of the execution; the weight stays in cash and earns 0.
    * ``held``: priced within ``tolerance`` sessions of the next execution too.
    * ``liquidated``: not so; sold at the last price seen after the purchase and before the next execution.
    * ``written_off``: no price at all after the purchase; the weight is lost (-1).
    * ``open``: bought at the last execution of its plan; the return is null.

    Null, zero, negative and NaN prices count as no price. A tolerance never reaches past the next execution.
    """
    # Only a period that some run holds a name in, and the next one, decide a fate; their windows are read twice.
    both = F.explode(F.array("period", F.col("period") + 1)).alias("period")
    asked = weights.select("plan", entity, both).distinct()
    seen = cut_lineage(price_windows(prices, dates, plan, tolerance, entity, asked))
    later = seen.select("plan", entity, (F.col("period") - 1).alias("period"), F.col("first_date").alias("_xd"), F.col("first_price").alias("_xp"))
    when = F.broadcast(plan.select("plan", "period", "exec_date", "next_date"))  # one row per plan and rebalance
    keys = ["plan", entity, "period"]
    rows = weights.join(seen, keys, "left").join(later, keys, "left").join(when, ["plan", "period"])
    dropped = F.col("last_date") > F.col("first_date")
    state = (
        F.when(F.col("first_price").isNull(), "not_bought").when(F.col("next_date").isNull(), "open")
        .when(F.col("_xp").isNotNull(), "held").when(dropped, "liquidated").otherwise("written_off")
    )
    exit_price = F.when(F.col("state") == "held", F.col("_xp")).when(F.col("state") == "liquidated", F.col("last_price"))
    ret = (
        F.when(F.col("state") == "not_bought", 0.0).when(F.col("state") == "written_off", -1.0)
        .when(F.col("state") != "open", F.col("exit_price") / F.col("first_price") - 1.0)
    )
    exit_date = F.when(F.col("state") == "held", F.col("_xd")).when(F.col("state") == "liquidated", F.col("last_date"))
    rows = rows.withColumn("state", state).withColumn("exit_price", exit_price).withColumn("ret", ret).withColumn("exit_date", exit_date)
    return rows.select(
        "run", "plan", "period", entity, "weight", "exec_date", "next_date", F.col("first_date").alias("entry_date"),
        F.col("first_price").alias("entry_price"), "exit_date", "exit_price", "state", "ret",
    )


def run_periods(held: DataFrame, costs: DataFrame, entity: str = "ticker") -> DataFrame:
    """Per run and period: gross return, turnover against drifted weights, cost and net return, and how many names met which fate.

    ``costs``: ``run, bps`` (one declared row per run). What is not bought stays in cash; what is lost needs no sale. The open period has
    turnover and cost but no return.
    """
    w = F.when(F.col("state") != "not_bought", F.col("weight")).otherwise(0.0)
    rows = held.withColumn("_w", w)
    closed = F.col("state").isin(*BOUGHT)
    gross = rows.groupBy("run", "period", "exec_date", "next_date").agg(
        F.when(F.col("next_date").isNotNull(), F.coalesce(F.sum(F.when(closed, F.col("_w") * F.col("ret"))), F.lit(0.0))).alias("gross"),
        *[F.count_if(F.col("state") == s).cast("long").alias(f"n_{s}") for s in ("held", "liquidated", "written_off", "not_bought", "open")],
    )
    kept = rows.where(closed).join(F.broadcast(gross.select("run", "period", "gross")), ["run", "period"])  # one row per run and rebalance
    drifted = F.try_divide(F.col("_w") * (1 + F.col("ret")), 1 + F.col("gross"))
    old = kept.select("run", (F.col("period") + 1).alias("period"), entity, (-F.coalesce(drifted, F.lit(0.0))).alias("_x"))
    moves = rows.select("run", "period", entity, F.col("_w").alias("_x")).transform(stacked, old).groupBy("run", "period", entity).agg(F.sum("_x").alias("_x"))
    turnover = moves.groupBy("run", "period").agg(F.sum(F.abs("_x")).alias("turnover"))
    out = gross.join(turnover, ["run", "period"]).join(F.broadcast(costs), "run")
    out = out.withColumn("cost", F.col("turnover") * F.col("bps") / 1e4).withColumn("net", F.col("gross") - F.col("cost"))
    return out.drop("bps")


def run_growth(periods: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per run over its closed periods: compound growth, CAGR, the benchmark's CAGR between the same sessions, and the excess.

    ``benchmark``: ``date, close_adj``, one row per session. A run that loses everything has a CAGR of -1.
    """
    runs = periods.where(F.col("next_date").isNotNull()).groupBy("run").agg(
        F.product(F.greatest(1.0 + F.col("net"), F.lit(0.0))).alias("growth"), F.count(F.lit(1)).alias("n_periods"),
        F.min("exec_date").alias("start"), F.max("next_date").alias("end"),
    )
    b = benchmark.select("date", "close_adj")
    out = runs.join(F.broadcast(b.select(F.col("date").alias("start"), F.col("close_adj").alias("_a"))), "start", "left")  # one row per session
    out = out.join(F.broadcast(b.select(F.col("date").alias("end"), F.col("close_adj").alias("_z"))), "end", "left")
    power = F.lit(365.25) / F.datediff("end", "start")
    out = out.withColumn("cagr", F.pow("growth", power) - 1).withColumn("benchmark_cagr", F.pow(F.try_divide("_z", "_a"), power) - 1)
    return out.withColumn("excess", F.col("cagr") - F.col("benchmark_cagr")).drop("_a", "_z")
