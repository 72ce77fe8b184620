"""Query registry and the mapping of the supplied tables onto panel concepts.

Each registered query is a function of a ``Tables`` object; its oracle is a SQL text over the same tables. ``WITH`` fragments shared by
several oracles live in ``CTE`` and are spliced in by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import rd
from panelstone.session import cut_lineage, stacked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MARKET = "MKT"
MODELS = ("operating", "cyclical", "bank", "unprofitable_growth", "operating", "reit")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may reference shared fragments as ``{{with a, b}}``."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def expand(sql: str) -> str:
    """Replace ``{{with a, b}}`` by the named fragments and everything they depend on, in dependency order."""

    def splice(match):
        done: list[str] = []

        def visit(name):
            for dep in NEEDS.get(name, ()):
                visit(dep)
            if name not in done:
                done.append(name)

        for name in match.group(1).split(","):
            visit(name.strip())
        return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in done)

    return re.sub(r"\{\{with ([^}]*)\}\}", splice, sql)


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rd``."""
    return f"(round(({expr}) + 3.7e-10, {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = 6, **override: int) -> DataFrame:
    """Round every double column for comparison with the oracle."""
    return df.select(*[rd(x, override.get(x, digits)).alias(x) if t == "double" else F.col(x) for x, t in df.dtypes])


def round_sql(body: str, cols: list[str], doubles: list[str], digits: int = 6, **override: int) -> str:
    """Wrap a SELECT so that the listed double columns are rounded."""
    out = ", ".join(f"{R(c, override.get(c, digits))} AS {c}" if c in doubles else c for c in cols)
    return f"SELECT {out} FROM ({body}) _q"


CTE: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def fragment(name: str, sql: str, *needs: str) -> None:
    if name in CTE:
        raise ValueError(f"duplicate fragment {name}")
    CTE[name] = sql
    NEEDS[name] = needs


fragment(
    "co",
    """SELECT 'cik' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS company_id, 'T' || s_suppkey AS ticker, s_suppkey AS cik,
       r_name AS sector, n_name AS industry,
       CASE s_suppkey % 6 WHEN 0 THEN 'operating' WHEN 1 THEN 'cyclical' WHEN 2 THEN 'bank' WHEN 3 THEN 'unprofitable_growth'
            WHEN 4 THEN 'operating' ELSE 'reit' END AS business_model
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
fragment(
    "sd",
    """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q, count(*) AS n,
       max(l_linenumber) AS ln, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS nr
       FROM lineitem GROUP BY 1, 2""",
)
fragment(
    "px",
    """SELECT 'T' || l_suppkey AS ticker, date, 20 + q / n AS close_raw, 20 + q / n AS close_adj, q AS volume,
       (20 + q / n) * q AS dollar_volume,
       CASE WHEN n >= 3 AND ln = 7 THEN 2.0 WHEN n >= 3 AND ln = 6 THEN NULL ELSE 1.0 END AS split_ratio,
       CASE WHEN nr >= 2 THEN nr * 0.25 ELSE 0.0 END AS dividend FROM sd""",
    "sd",
)
fragment("mk", "SELECT date, 20 + sum(q) / sum(n) AS close FROM sd GROUP BY 1", "sd")
fragment(
    "sf",
    """SELECT sector, date, 20 + sum(q) / sum(n) AS close FROM sd JOIN co ON cik = l_suppkey GROUP BY 1, 2""",
    "sd", "co",
)
fragment(
    "mraw",
    """SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS rev, sum(l_quantity) AS q, count(*) AS n,
       CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 AS d,
       CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 AS t FROM lineitem GROUP BY 1, 2""",
)
fragment(
    "mend",
    "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, max(CAST(l_shipdate AS DATE)) AS date FROM lineitem GROUP BY 1",
)
fragment(
    "pan",
    """SELECT company_id, ticker, date, sector, industry, business_model, rev, q, n, d, t, 20 + q / n AS close_adj,
       (20 + q / n) * q AS market_cap,
       d / n AS roic, t / n AS roe, 1 - d / n AS gross_margin, (1 - d / n) * (1 - t / n) AS operating_margin,
       CASE WHEN cik % 7 = 0 THEN NULL ELSE q / n / 50 END AS fcf_margin,
       CAST(n AS DOUBLE) / (q + 1) AS accrual_ratio,
       n / lag(CAST(n AS DOUBLE), 12) OVER w - 1 AS revenue_growth_1y,
       q / lag(q, 3) OVER w - 1 AS growth_acceleration,
       lag(20 + q / n, 1) OVER w / lag(20 + q / n, 12) OVER w - 1 AS mom_12_1,
       (20 + q / n) / lag(20 + q / n, 3) OVER w - 1 AS ret_3m,
       (20 + q / n) / max(20 + q / n) OVER (PARTITION BY company_id ORDER BY date ROWS 11 PRECEDING) - 1 AS near_52w_high,
       (20 + q / n) * 100 / (n * 10 + d * 100) AS ev_ebit, n / (20 + q / n) AS earnings_yield,
       (20 + q / n) / (t + 1) AS price_to_book, d / (20 + q / n) AS shareholder_yield
       FROM mraw JOIN mend USING (month) JOIN co ON cik = l_suppkey
       WINDOW w AS (PARTITION BY company_id ORDER BY date)""",
    "mraw", "mend", "co",
)
PANEL_METRICS = (
    "roic roe gross_margin operating_margin fcf_margin accrual_ratio revenue_growth_1y growth_acceleration mom_12_1 ret_3m "
    "near_52w_high ev_ebit earnings_yield price_to_book shareholder_yield"
).split()
fragment(
    "fwd",
    """SELECT *, lead(close_adj, 1) OVER w / close_adj - 1 AS fwd_1m, lead(close_adj, 3) OVER w / close_adj - 1 AS fwd_3m
       FROM pan WINDOW w AS (PARTITION BY company_id ORDER BY date)""",
    "pan",
)


def cents(column: str):
    """Sum in whole cents: exact whatever the order of addition, so equal totals stay equal."""
    return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double") / 100


class Tables:
    """The supplied tables and their reading as prices, companies, monthly panel and facts."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def companies(self) -> DataFrame:
        """Suppliers as companies; nation and region are fixed 25- and 5-row tables."""
        nations = self.raw("nation").join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("s_suppkey")
        model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (key % 6 + 1).cast("int"))
        return self.raw("supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("cik"), F.lpad(key.cast("string"), 10, "0")).alias("company_id"),
            F.concat(F.lit("T"), key.cast("string")).alias("ticker"),
            key.alias("cik"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            model.alias("business_model"),
            F.lit(True).alias("is_primary"),
        )

    @cached_property
    def supplier_days(self) -> DataFrame:
        """One row per supplier and ship date: the map-side-combined aggregate every price series is derived from."""
        return self.raw("lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date")).agg(
            F.sum("l_quantity").alias("q"),
            F.count(F.lit(1)).alias("n"),
            F.max("l_linenumber").alias("ln"),
            F.count_if(F.col("l_returnflag") == "R").alias("nr"),
        )

    def keep_days(self) -> None:
        """Write ``supplier_days`` once and read prices, market and sessions from it, for queries that need them several times."""
        if "_kept" not in self.__dict__:
            self._kept = self.supplier_days = cut_lineage(self.supplier_days)
            self.sessions = cut_lineage(self._kept.select("date").distinct())

    def keep_funds(self) -> None:
        """Write ``supplier_days``, the market and the sector funds once; each reader of ``all_prices`` would aggregate the lines anew."""
        self.supplier_days = cut_lineage(self.supplier_days)
        self.market, self.sector_funds = cut_lineage(self.market), cut_lineage(self.sector_funds)

    @cached_property
    def prices(self) -> DataFrame:
        close = 20 + F.col("q") / F.col("n")
        ratio = F.when((F.col("n") >= 3) & (F.col("ln") == 7), 2.0).when((F.col("n") >= 3) & (F.col("ln") == 6), None).otherwise(1.0)
        return self.supplier_days.select(
            F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"),
            "date",
            close.alias("close_raw"),
            close.alias("close_adj"),
            F.col("q").alias("volume"),
            (close * F.col("q")).alias("dollar_volume"),
            ratio.alias("split_ratio"),
            F.when(F.col("nr") >= 2, F.col("nr") * 0.25).otherwise(0.0).alias("dividend"),
        )

    def _fund(self, df: DataFrame, ticker) -> DataFrame:
        close = 20 + F.col("q") / F.col("n")
        return df.select(
            ticker.alias("ticker"), "date", close.alias("close_raw"), close.alias("close_adj"), F.col("q").alias("volume"),
            (close * F.col("q")).alias("dollar_volume"), F.lit(1.0).alias("split_ratio"), F.lit(0.0).alias("dividend"),
        )

    @cached_property
    def market(self) -> DataFrame:
        days = self.supplier_days.groupBy("date").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
        return self._fund(days, F.lit(MARKET))

    @cached_property
    def sector_funds(self) -> DataFrame:
        sectors = self.companies.select(F.col("cik").alias("l_suppkey"), "sector")
        days = self.supplier_days.join(sectors, "l_suppkey").groupBy("sector", "date").agg(F.sum("q").alias("q"), F.sum("n").alias("n"))
        return self._fund(days, F.concat(F.lit("F_"), F.col("sector")))

    @cached_property
    def all_prices(self) -> DataFrame:
        """Securities, the market and the sector funds in one price table."""
        return self.prices.transform(stacked, self.market).transform(stacked, self.sector_funds)

    @cached_property
    def fund_map(self) -> dict[str, str]:
        """Sector to fund ticker; the region table is a fixed five-row dimension."""
        return {r["r_name"]: f"F_{r['r_name']}" for r in self.raw("region").select("r_name").collect()}

    @cached_property
    def sessions(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()

    @cached_property
    def panel(self) -> DataFrame:
        """Month-end company panel with a spread of metric columns."""
        line = self.raw("lineitem")
        month = F.trunc("l_shipdate", "MM")
        cells = line.groupBy("l_suppkey", month.alias("month")).agg(
            cents("l_extendedprice").alias("rev"), F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"),
            cents("l_discount").alias("d"), cents("l_tax").alias("t"),
        )
        ends = line.groupBy(month.alias("month")).agg(F.max(F.col("l_shipdate").cast("date")).alias("date"))
        who = self.companies.select("company_id", "ticker", F.col("cik").alias("l_suppkey"), "sector", "industry", "business_model")
        base = cells.join(F.broadcast(ends), "month").join(who, "l_suppkey")  # one row per month
        c = F.col
        w = Window.partitionBy("l_suppkey").orderBy("date")  # one company for each key: rows stay where the join put them
        close = 20 + c("q") / c("n")
        base = base.withColumns({"close_adj": close, "market_cap": close * c("q")})
        back = lambda x, k: F.lag(x, k).over(w)
        return base.withColumns(
            {
                "roic": c("d") / c("n"),
                "roe": c("t") / c("n"),
                "gross_margin": 1 - c("d") / c("n"),
                "operating_margin": (1 - c("d") / c("n")) * (1 - c("t") / c("n")),
                "fcf_margin": F.when(c("l_suppkey") % 7 != 0, c("q") / c("n") / 50),
                "accrual_ratio": c("n") / (c("q") + 1),
                "revenue_growth_1y": c("n") / back("n", 12) - 1,
                "growth_acceleration": c("q") / back("q", 3) - 1,
                "mom_12_1": back("close_adj", 1) / back("close_adj", 12) - 1,
                "ret_3m": c("close_adj") / back("close_adj", 3) - 1,
                "near_52w_high": c("close_adj") / F.max("close_adj").over(w.rowsBetween(-11, 0)) - 1,
                "ev_ebit": c("close_adj") * 100 / (c("n") * 10 + c("d") * 100),
                "earnings_yield": c("n") / c("close_adj"),
                "price_to_book": c("close_adj") / (c("t") + 1),
                "shareholder_yield": c("d") / c("close_adj"),
            }
        ).drop("l_suppkey", "month").transform(cut_lineage)  # every query over the panel reads it more than once

    @cached_property
    def forward(self) -> DataFrame:
        """The panel with one- and three-month forward returns as targets."""
        w = Window.partitionBy("company_id").orderBy("date")
        ahead = lambda k: F.lead("close_adj", k).over(w) / F.col("close_adj") - 1
        return self.panel.withColumns({"fwd_1m": ahead(1), "fwd_3m": ahead(3)})
