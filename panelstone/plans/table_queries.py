"""Table contracts, sources and sinks, plain joins and aggregates, and source normalisation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelstone.functions import numeric as N
from panelstone.operators import ingest as G
from panelstone.operators import membership as M
from panelstone.plans.base import R, Tables, fragment, query, rounded
from panelstone.session import PART_BYTES, dealt, shared_folder, stacked
from panelstone.sources import contracts as C
from panelstone.sources import tables as S


def scratch(t: Tables) -> str:
    """A fresh root in the shared folder for one query's tables."""
    return f"{shared_folder(t.spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


fragment("pr", "SELECT ticker, date, close_raw, close_adj, volume, dollar_volume, split_ratio, dividend FROM px", "px")
_PR = f"ticker, date, {R('close_raw')} AS close_raw, {R('volume')} AS volume, {R('split_ratio')} AS split_ratio"
_PC = ["ticker", "date", "close_raw", "volume", "split_ratio"]


@query("src1_read", f"{{{{with pr}}}} SELECT {_PR} FROM pr")
def _(t):
    root = scratch(t)
    S.write(t.prices, root, "prices")
    return rounded(S.read(t.spark, root, "prices", required=True).select(*_PC))


@query("src2_scan", f"{{{{with pr}}}} SELECT {_PR} FROM pr WHERE date >= DATE '2000-01-01' AND ticker = 'T7'")
def _(t):
    root = scratch(t)
    S.write(t.prices, root, "prices")
    return rounded(S.scan(t.spark, root, "prices").where("date >= '2000-01-01' and ticker = 'T7'").select(*_PC))


@query("snk1_write_profile", "{{with pr}} SELECT count(*) AS rows, count(DISTINCT ticker) AS entities, min(date) AS first_date, max(date) AS last_date, count(*) - count(split_ratio) AS null_splits FROM pr")
def _(t):
    root = scratch(t)
    S.write(t.prices, root, "prices")
    out = C.profile(S.scan(t.spark, root, "prices"), C.TABLES["prices"])
    return out.select("rows", "entities", "first_date", "last_date", F.col("null_counts")["split_ratio"].alias("null_splits"))


@query("con6_profile", "{{with pr}} SELECT count(*) AS rows, count(DISTINCT ticker) AS entities, min(date) AS first_date, max(date) AS last_date, count(*) - count(split_ratio) AS null_splits FROM pr")
def _(t):
    out = C.profile(t.prices, C.TABLES["prices"])
    return out.select("rows", "entities", "first_date", "last_date", F.col("null_counts")["split_ratio"].alias("null_splits"))


@query("snk2_upsert", f"{{{{with pr}}}}, o AS (SELECT * FROM pr WHERE date < DATE '2000-01-01'), i AS (SELECT * REPLACE (close_raw + 1 AS close_raw) FROM pr WHERE date >= DATE '1999-06-01') SELECT {_PR} FROM (SELECT * FROM i UNION ALL SELECT * FROM o ANTI JOIN i USING (ticker, date))")
def _(t):
    root = scratch(t)
    S.write(t.prices.where("date < '2000-01-01'"), root, "prices")
    S.upsert(t.prices.where("date >= '1999-06-01'").withColumn("close_raw", F.col("close_raw") + 1), root, "prices")
    return rounded(S.scan(t.spark, root, "prices").select(*_PC))


@query("snk2_upsert_sequence", f"""{{{{with pr}}}}, i AS (SELECT 'T' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, arg_max(l_quantity, (l_orderkey, l_linenumber)) AS close_raw FROM lineitem WHERE l_shipdate >= DATE '1999-06-01' GROUP BY ALL)
   SELECT ticker, date, {R('close_raw')} AS close_raw FROM (SELECT * FROM i UNION ALL SELECT ticker, date, close_raw FROM pr WHERE date < DATE '2000-01-01' AND (ticker, date) NOT IN (SELECT (ticker, date) FROM i))""")
def _(t):
    """Several rows of a load for one key: the last recorded wins, though it may hold a lower value."""
    root = scratch(t)
    S.write(t.prices.where("date < '2000-01-01'"), root, "prices")
    lines = t.raw("lineitem").where("l_shipdate >= '1999-06-01'")
    ticker, day = F.concat(F.lit("T"), F.col("l_suppkey").cast("string")).alias("ticker"), F.col("l_shipdate").cast("date").alias("date")
    load = lines.select(ticker, day, F.col("l_quantity").alias("close_raw"), F.col("l_quantity").alias("close_adj"), "l_orderkey", "l_linenumber")
    S.upsert(load, root, "prices", sequence=("l_orderkey", "l_linenumber"))
    return rounded(S.scan(t.spark, root, "prices").select("ticker", "date", "close_raw"))


@query("snk3_append", "SELECT 'O' || o_orderkey AS trial_id, o_orderpriority AS strategy FROM orders")
def _(t):
    root = scratch(t)
    every = C.coerce(t.raw("orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("trial_id"), F.col("o_orderdate").alias("recorded_at"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("period"), "o_custkey"), C.TABLES["experiments"])
    early = every.where("period = 'F'")
    S.append(early, root, "experiments")
    S.append(every.where("period <> 'F'"), root, "experiments")
    try:
        S.append(early, root, "experiments")  # recorded keys are refused
        raise AssertionError("a recorded trial was overwritten")
    except ValueError:
        pass
    return S.scan(t.spark, root, "experiments").select("trial_id", "strategy")


fragment("sig", """SELECT ticker AS entity, date AS dt, 'market.price' AS kind, close_raw AS value FROM px UNION ALL SELECT ticker, date, 'market.volume', volume FROM px
   UNION ALL SELECT ticker, date, 'market.volatility', (close_raw * 1.02 - close_raw * 0.99) / close_raw FROM px""", "px")


def bars(prices):
    return prices.select("ticker", "date", F.col("close_raw").alias("close"), (F.col("close_raw") * 1.02).alias("high"), (F.col("close_raw") * 0.99).alias("low"), "volume")


@query("ing25_bars_to_signals", f"{{{{with sig}}}} SELECT entity, dt, kind, {R('value')} AS value FROM sig")
def _(t):
    return rounded(G.bars_to_signals(bars(t.prices), "lines").select("entity", F.col("asof").alias("dt"), "kind", "value"))


@query("ing26_dedupe_signals", "{{with sig}} SELECT kind, count(*) AS n FROM sig GROUP BY 1")
def _(t):
    # Every bar twice, dealt before it makes three wide rows.
    closes = t.prices.select("ticker", "date", "close_raw", "volume")
    twice = dealt(closes.transform(stacked, closes), "ticker", "date", part_bytes=PART_BYTES // 2)
    s = G.bars_to_signals(bars(twice), "lines").drop("meta")
    return G.dedupe_signals(s, near=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_src3_signals", f"{{{{with pan}}}} SELECT ticker AS entity, date AS dt, {R('close_adj')} AS value FROM pan WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'")
def _(t):
    root = scratch(t)
    month_bars = t.panel.select("ticker", "date", F.col("close_adj").alias("close"), F.col("close_adj").alias("high"), F.col("close_adj").alias("low"), F.col("q").alias("volume"))
    S.write_signals(G.bars_to_signals(month_bars, "lines").drop("meta"), root)
    return rounded(S.load_signals(t.spark, root, "market.price", "1999-01-01", "1999-06-30").select("entity", F.col("asof").alias("dt"), "value"))


@query("snk5_src4_partition", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey > 5")
def _(t):
    root = scratch(t)
    base = t.raw("supplier").select("s_suppkey", "s_name", "s_nationkey")
    S.write_partition(base, root, "raw", "suppliers", "2024-01-01")
    S.write_partition(base, root, "raw", "suppliers", "2024-01-02")
    S.write_partition(base.where("s_nationkey > 5"), root, "raw", "suppliers", "2024-01-02")
    return S.read_partition(t.spark, root, "raw", "suppliers", "2024-01-02").select("s_suppkey", "s_name")


@query("src5_csv_series", f"{{{{with mk}}}} SELECT date, {R('close')} AS value FROM mk WHERE day(date) % 5 <> 0")
def _(t):
    root = f"{scratch(t)}/yield"
    text = F.when(F.dayofmonth("date") % 5 == 0, ".").otherwise(F.col("close_adj").cast("string"))
    t.market.select(F.col("date").cast("string").alias("DATE"), text.alias("DGS10")).write.option("header", True).csv(root)
    return rounded(S.read_csv_series(t.spark, root, "DATE", "DGS10"))


@query("src6_csv_dictionary", "SELECT lower(s_name) AS domain, 'T' || s_suppkey AS ticker FROM supplier")
def _(t):
    root = f"{scratch(t)}/dictionary"
    t.raw("supplier").select(F.col("s_name").alias("domain"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("ticker")).write.option("header", True).csv(root)
    return S.read_dictionary(t.spark, root).select("domain", "ticker")


# ---- contracts


@query("con1_validate", """SELECT 'null_in_required' AS problem, 'c_acctbal' AS subject, count(*) AS n FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'duplicate_key', (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment AS k FROM customer GROUP BY 1 HAVING count(*) > 1 ORDER BY k LIMIT 3)),
   (SELECT count(*) FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1))""")
def _(t):
    spec = C.TableSpec("by_segment", "raw", "c_nationkey int, c_mktsegment string, c_acctbal double", ("c_nationkey", "c_mktsegment"), required=("c_acctbal",))
    df = t.raw("customer").select("c_nationkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    return C.validate(df, spec)


@query("con2_coerce", f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(NULL AS INTEGER) AS p_name, {R('CAST(p_size AS DOUBLE)')} AS p_size, CAST(NULL AS DATE) AS listed FROM part")
def _(t):
    spec = C.TableSpec("x", "raw", "p_partkey string, p_name int, p_size double, listed date", ("p_partkey",))
    return rounded(C.coerce(t.raw("part"), spec))


@query("con3_migrate", f"SELECT p_partkey, upper(p_brand) AS label, {R('p_retailprice / 100')} AS price FROM part")
def _(t):
    spec = C.TableSpec("x", "raw", "p_partkey bigint, label string, price double", ("p_partkey",), renames={"p_brand": "label", "p_retailprice": "price"},
                       transform=lambda df: df.withColumns({"label": F.upper("label"), "price": F.col("price") / 100}))
    return rounded(C.migrate(t.raw("part"), spec).select("p_partkey", "label", "price"))


@query("con4_percent_to_fraction", f"SELECT l_orderkey, l_linenumber, {R('CASE WHEN (SELECT median(abs(l_quantity)) FROM lineitem) > 1 THEN greatest(least(l_quantity / 100, 10), -10) ELSE l_quantity END')} AS a, {R('l_discount')} AS b FROM lineitem")
def _(t):
    df = t.raw("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return rounded(C.percent_to_fraction(C.percent_to_fraction(C.percent_to_fraction(df, "a"), "a"), "b"))


@query("con5_membership_defaults", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS entry_date, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS entry_observed_by, CASE WHEN o_orderstatus <> 'F' THEN 'exact' ELSE 'unknown' END AS entry_precision,
   CASE WHEN o_orderstatus = 'O' THEN 'bracketed' ELSE 'still_member' END AS exit_precision, 'current-list' AS universe_version FROM orders""")
def _(t):
    d, st = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    df = t.raw("orders").select("o_orderkey", F.when(st != "F", d).alias("entry_date"), F.when(st == "O", d).alias("exit_date"), F.lit(None).cast("date").alias("entry_observed_by"), none.alias("entry_precision"), none.alias("exit_precision"), none.alias("universe_version"))
    return C.membership_defaults(df).drop("exit_date")


def profiles(t: Tables):
    specs = {"orders": ("o_orderkey", "o_custkey", "o_orderdate"), "lineitem": ("l_orderkey", "l_suppkey", "l_shipdate"), "events": ("event_id", "user_id", "ts")}
    out = None
    for name, (key, entity, date) in specs.items():
        p = C.profile(t.raw(name), C.TableSpec(name, "raw", "x int", (key,), entity=entity, date=date)).drop("null_counts")
        out = p if out is None else out.transform(stacked, p)
    return out


@query("con7_health", """WITH p AS (SELECT 'orders' AS "table", count(*) AS rows, CAST(max(o_orderdate) AS DATE) AS d, 500 AS m FROM orders UNION ALL SELECT 'lineitem', count(*), CAST(max(l_shipdate) AS DATE), 10 FROM lineitem UNION ALL SELECT 'events', count(*), CAST(max(ts) AS DATE), 10 FROM events UNION ALL SELECT 'prices', NULL, NULL, 5)
   SELECT "table", rows, d AS last_date, CAST(DATE '2002-01-01' - d AS INTEGER) AS age_days, CASE WHEN rows IS NULL THEN 'missing' WHEN rows = 0 THEN 'empty' WHEN DATE '2002-01-01' - d > m THEN 'stale' ELSE 'ok' END AS status FROM p""")
def _(t):
    specs = [C.TableSpec(n, "raw", "x int", ("x",), max_age_days=m) for n, m in (("orders", 500), ("lineitem", 10), ("events", 10), ("prices", 5))]
    return C.health(profiles(t), specs, F.lit("2002-01-01").cast("date"))


@query("con8_data_version", """WITH p AS (SELECT 'orders|' || count(*) || '|' || CAST(min(o_orderdate) AS DATE) || '|' || CAST(max(o_orderdate) AS DATE) AS l FROM orders UNION ALL SELECT 'lineitem|' || count(*) || '|' || CAST(min(l_shipdate) AS DATE) || '|' || CAST(max(l_shipdate) AS DATE) FROM lineitem
   UNION ALL SELECT 'events|' || count(*) || '|' || CAST(min(ts) AS DATE) || '|' || CAST(max(ts) AS DATE) FROM events) SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS data_version, count(*) AS tables FROM p""")
def _(t):
    return C.data_version(profiles(t))


# ---- joins

_CO = "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query("jn1_inner", _CO)
def _(t):
    dims = t.raw("nation").join(F.broadcast(t.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return t.raw("customer").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("jn2_left", f"SELECT c_custkey, count(o_orderkey) AS n_orders, {R('sum(o_totalprice)', 2)} AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(t):
    # The large side is reduced before it moves.
    per = t.raw("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n"), F.sum("o_totalprice").alias("total"))
    out = t.raw("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rounded(out.select("c_custkey", F.coalesce("_n", F.lit(0)).alias("n_orders"), "total"), 2)


@query("jn4_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(t):
    returned = t.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.raw("orders").select("o_orderkey").join(returned, "o_orderkey", "left_semi")


@query("jn5_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    urgent = t.raw("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.raw("customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("jn15_union_by_name", "SELECT 'supplier' AS kind, s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    s = t.raw("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = t.raw("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return s.transform(stacked, c, allowMissingColumns=True)


@query("jn16_concat", "SELECT 'order' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'line', count(*) FROM lineitem UNION ALL SELECT 'event', count(*) FROM events")
def _(t):
    count = lambda name, table: t.raw(table).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    return count("order", "orders").transform(stacked, count("line", "lineitem")).transform(stacked, count("event", "events"))


# ---- aggregates


@query("ag1_group_statistics", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {R('sum(l_quantity)')} AS total, {R('avg(l_quantity)')} AS mean, {R('min(l_quantity)')} AS low, {R('max(l_quantity)')} AS high, {R('median(l_quantity)')} AS mid, {R('stddev_samp(l_quantity)')} AS dev FROM lineitem GROUP BY 1, 2")
def _(t):
    q = "l_quantity"
    return rounded(t.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("total"), F.avg(q).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.median(q).alias("mid"), F.stddev_samp(q).alias("dev")))


@query("ag2_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _(t):
    return t.raw("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("ag3_conditional", f"SELECT l_suppkey, {R('''sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * l_discount ELSE 0 END)''')} AS weighted, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def _(t):
    flag = F.col("l_returnflag")
    return rounded(t.raw("lineitem").groupBy("l_suppkey").agg(F.sum(F.when(flag == "A", F.col("l_quantity") * F.col("l_discount")).otherwise(0.0)).alias("weighted"), F.count_if(flag == "R").alias("returned")))


@query("ag4_ordered_first_last", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def _(t):
    order = F.struct("o_orderdate", "o_orderkey")
    return t.raw("orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("first_order"), F.max_by("o_orderkey", order).alias("last_order"))


@query("ag6_bool_any", "SELECT o_custkey, bool_or(o_orderstatus = 'O') AS any_open FROM orders GROUP BY 1")
def _(t):
    return t.raw("orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("any_open"))


@query("ag7_pivot", f"SELECT l_suppkey, {R('''sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END)''')} AS \"A\", {R('''sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END)''')} AS \"N\", {R('''sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END)''')} AS \"R\" FROM lineitem GROUP BY 1")
def _(t):
    return rounded(t.raw("lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")))


@query("ag8_sorted_list", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def _(t):
    return t.raw("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))  # a declared list of types


@query("ag12_bucket_aggregate", f"SELECT CAST(least(floor(l_discount * 50), 4) AS INTEGER) AS bucket, {R('avg(l_tax)')} AS mean, {R('stddev_samp(l_tax)')} AS dev, {R('avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0 END)')} AS hit, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    b = F.least(F.floor(F.col("l_discount") * 50), F.lit(4)).cast("int")
    return rounded(t.raw("lineitem").groupBy(b.alias("bucket")).agg(F.avg("l_tax").alias("mean"), F.stddev_samp("l_tax").alias("dev"), F.avg((F.col("l_tax") > 0.04).cast("double")).alias("hit"), F.count(F.lit(1)).alias("n")))


# ---- source normalisation


@query("ing18_spread", f"SELECT l_orderkey, l_linenumber, {R('CASE WHEN l_tax > l_discount AND l_discount > 0 THEN (l_tax - l_discount) / ((l_tax + l_discount) / 2) * 1e4 END')} AS spread_bps FROM lineitem")
def _(t):
    return rounded(t.raw("lineitem").select("l_orderkey", "l_linenumber", G.spread_bps("l_discount", "l_tax").alias("spread_bps")))


@query("ing19_clean", f"SELECT l_orderkey, l_linenumber, {R('CASE WHEN l_discount > 0 THEN l_tax / l_discount END')} AS clean FROM lineitem")
def _(t):
    zero = F.col("l_discount") == 0
    dirty = F.when(zero & (F.col("l_tax") == 0), float("nan")).when(zero, float("inf")).otherwise(F.try_divide("l_tax", "l_discount"))
    return rounded(t.raw("lineitem").select("l_orderkey", "l_linenumber", N.finite(dirty).alias("clean")))


@query("ing20_symbols", "SELECT p_partkey, upper(substr(p_brand, 1, 3)) || '-' || upper(substr(p_type, 1, 1 + CAST(p_partkey % 3 AS INTEGER))) AS symbol, CASE WHEN p_partkey % 3 < 2 THEN upper(substr(p_type, 1, 1 + CAST(p_partkey % 3 AS INTEGER))) END AS class FROM part")
def _(t):
    n = (1 + F.col("p_partkey") % 3).cast("int")
    raw = F.concat(F.lit(" "), F.lower(F.substring("p_brand", 1, 3)), F.lit("."), F.lower(F.substring(F.col("p_type"), F.lit(1), n)), F.lit(" "))
    df = t.raw("part").withColumn("raw", raw).withColumn("symbol", M.normal_symbol("raw"))
    return df.select("p_partkey", "symbol", M.share_class("symbol").alias("class"))


def postings(t: Tables):
    c = F.col
    return t.raw("events").select(
        c("event_type").alias("platform"), F.when(c("user_id") % 7 < 5, F.concat(F.lit("Supplier#00000000"), (c("user_id") % 7).cast("string"))).otherwise("nobody").alias("domain"), F.when(c("event_id") % 3 != 0, c("event_id") % 500).alias("posting_id"),
        F.concat(F.lit("job "), (c("event_id") % 40).cast("string")).alias("title"), F.lit("here").alias("location"))


fragment("po", "SELECT event_type AS platform, CASE WHEN user_id % 7 < 5 THEN 'supplier#00000000' || user_id % 7 ELSE 'nobody' END AS domain, CASE WHEN event_id % 3 <> 0 THEN event_id % 500 END AS posting_id, CASE WHEN event_id % 3 = 0 THEN event_id % 40 END AS title FROM events")


@query("ing21_normalise_postings", "{{with po}} SELECT platform, lower(domain) AS domain, CAST(posting_id AS VARCHAR) AS posting_id FROM po GROUP BY platform, domain, posting_id, title")
def _(t):
    return G.normalise_postings(postings(t), "2024-01-31").select("platform", F.lower("domain").alias("domain"), "posting_id")


def dictionary(t: Tables):
    return t.raw("supplier").select(F.col("s_name").alias("domain"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("ticker"))


@query("ing22_resolve_ticker", f"{{{{with po}}}} SELECT s_suppkey IS NOT NULL AS found, 'T' || s_suppkey AS ticker, {R('CASE WHEN s_suppkey IS NULL THEN 0.0 ELSE 1.0 END')} AS confidence, count(*) AS n FROM po LEFT JOIN supplier ON lower(s_name) = domain GROUP BY ALL")
def _(t):
    out = G.resolve_ticker(postings(t), dictionary(t))
    return rounded(out.groupBy(F.col("ticker").isNotNull().alias("found"), "ticker", "confidence").agg(F.count(F.lit(1)).alias("n")))


@query("ing24_posting_counts", "{{with po}} SELECT 'T' || s_suppkey AS ticker, '2024-01-31' AS dt, 'job_postings' AS feature_id, count(*) AS value FROM (SELECT DISTINCT platform, domain, posting_id, title FROM po) JOIN supplier ON lower(s_name) = domain GROUP BY 1")
def _(t):
    return G.posting_counts(G.resolve_ticker(G.normalise_postings(postings(t), "2024-01-31"), dictionary(t)))


@query("ing23_resolve_names", """WITH r AS (SELECT lower(n_name) AS c, lower('the ' || n_name || ' group') AS a, 'N' || n_nationkey AS tk FROM nation), n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(n_name) WHEN c_custkey % 3 = 1 THEN lower(n_name) || ' group' ELSE 'unknown' END AS nm FROM customer JOIN nation ON c_nationkey = n_nationkey)
   SELECT c_custkey, coalesce((SELECT min(tk) FROM r WHERE c = nm), (SELECT min(tk) FROM r WHERE contains(a, nm))) AS resolved_ticker FROM n""")
def _(t):
    registry = t.raw("nation").select(F.col("n_name").alias("company_name"), F.concat(F.lit("the "), F.col("n_name"), F.lit(" group")).alias("aliases"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"))
    k = F.col("c_custkey")
    df = t.raw("customer").join(F.broadcast(t.raw("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.withColumn("name", F.when(k % 3 == 0, F.col("n_name")).when(k % 3 == 1, F.concat("n_name", F.lit(" group"))).otherwise("unknown"))
    return G.resolve_names(df, registry).select("c_custkey", "resolved_ticker")


@query("qc3_price_disagreement", f"{{{{with px}}}}, l AS (SELECT ticker, arg_max(close_raw, date) AS price FROM px GROUP BY 1), o AS (SELECT ticker, arg_min(close_raw, date) AS other FROM px GROUP BY 1) SELECT ticker, {R('price')} AS price, {R('abs(price - other) / other')} AS gap FROM l JOIN o USING (ticker) WHERE abs(price - other) / other > 0.15")
def _(t):
    from panelstone.operators import reports as Q
    other = t.prices.groupBy("ticker").agg(F.min_by("close_raw", "date").alias("other_price"))
    return rounded(Q.price_disagreement(t.prices, other).select("ticker", "price", "gap"))


@query("rq5_price_tail", f"{{{{with px}}}}, c AS (SELECT *, close_adj / lag(close_adj) OVER w - 1 AS change, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM px WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, date, {R('close_adj')} AS close_adj, {R('change')} AS change, r = 1 AS is_last FROM c WHERE r <= 100")
def _(t):
    from panelstone.operators import reports as Q
    return rounded(Q.price_tail(t.prices, 100).select("ticker", "date", "close_adj", "change", "is_last"))


@query("rq12_recent_trials", """SELECT 'E' || event_id AS trial_id, json_extract_string(props, '$.k') AS k FROM events ORDER BY ts DESC, trial_id LIMIT 25""")
def _(t):
    from panelstone.operators import reports as Q
    trials = t.raw("events").select(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("trial_id"), F.col("ts").alias("recorded_at"), F.col("props").alias("params"))
    return Q.recent_trials(trials, 25, {"k": "$.k"}).select("trial_id", "k")
