"""Bitemporal facts, membership spells, identity, estimates and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstone.operators import estimates as ES
from panelstone.operators import ingest as G
from panelstone.operators import membership as M
from panelstone.operators import pit as P
from panelstone.operators import prices as PR
from panelstone.plans.base import MARKET, R, Tables, cents, fragment, query, round_sql, rounded
from panelstone.session import cut_lineage, stacked

# ---- facts: year-to-date cuts of quarterly sums, instants at quarter ends, averages; some restated, some off by a thousand

fragment("qx", """SELECT l_suppkey AS cik, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS qs, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS qe, CAST(date_trunc('year', l_shipdate) AS DATE) AS ys,
   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS rev, CAST(sum(l_quantity) AS DOUBLE) AS q FROM lineitem GROUP BY 1, 2, 3, 4""")
fragment("ob0", """SELECT cik, qs, qe, ys, sum(rev) OVER (PARTITION BY cik, ys ORDER BY qs) AS ytd, rev, q, qe + 30 + CAST(cik % 10 AS INTEGER) AS filed FROM qx""", "qx")
fragment("ob", """SELECT 'cik' || lpad(CAST(cik AS VARCHAR), 10, '0') AS company_id, tag, unit, period_start, period_end, filed, filed + 1 AS available_at, value, 'a' || cik || '-' || filed || '-' || tag AS accession FROM (
   SELECT cik, 'Revenues' AS tag, 'USD' AS unit, ys AS period_start, qe AS period_end, filed, CASE WHEN cik % 17 = 5 AND month(qe) = 6 THEN ytd / 1000 ELSE ytd END AS value FROM ob0
   UNION ALL SELECT cik, 'SalesRevenueNet', 'USD', qs, qe, filed, rev * 0.99 FROM ob0 WHERE cik % 4 = 1
   UNION ALL SELECT cik, 'Revenues', 'USD', ys, qe, filed + 365, ytd * 1.02 FROM ob0 WHERE cik % 3 = 0
   UNION ALL SELECT cik, 'Assets', 'USD', CAST(NULL AS DATE), qe, filed, rev * 2.5 FROM ob0
   UNION ALL SELECT cik, 'Assets', 'USD', CAST(NULL AS DATE), qe, filed + 90, rev * 2.6 FROM ob0 WHERE cik % 5 = 0
   UNION ALL SELECT cik, 'DilutedShares', 'shares', qs, qe, filed, q * 1000 FROM ob0
   UNION ALL SELECT cik, 'DilutedShares', 'shares', ys, qe, filed, q * 900 FROM ob0 WHERE month(qe) > 3)""", "ob0")
# Declared: concept, tag, unit, preference rank, period type, aggregation.
CATALOGUE = [("revenue", "Revenues", "USD", 1, "duration", "sum"), ("revenue", "SalesRevenueNet", "USD", 0, "duration", "sum"), ("assets", "Assets", "USD", 0, "instant", "last"), ("shares_diluted", "DilutedShares", "shares", 0, "duration", "last")]
_CAT = ", ".join(f"('{c}', '{t}', '{u}', {r}, '{p}', '{a}')" for c, t, u, r, p, a in CATALOGUE)
fragment("fc0", f"SELECT company_id, concept, period_start AS s, period_end AS e, filed, available_at AS av, value, accession, tr, pt, ag FROM ob JOIN (VALUES {_CAT}) c(concept, tag, unit, tr, pt, ag) ON ob.tag = c.tag AND ob.unit = c.unit", "ob")
fragment("fcb", "SELECT *, CASE WHEN s IS NULL THEN 'instant' WHEN e - s <= 120 THEN 'quarter' WHEN e - s <= 250 THEN 'half' ELSE 'year' END AS bkt FROM fc0", "fc0")
fragment("fcn", """SELECT *, list_sort(list_filter(list(abs(value)) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), lambda x: x > 0)) AS lb, list_sort(list_filter(list(abs(value)) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), lambda x: x > 0)) AS la,
   count(*) OVER (PARTITION BY company_id, concept, bkt) AS nb, count(*) OVER (PARTITION BY company_id, concept) AS na FROM fcb WINDOW w AS (PARTITION BY company_id, concept, bkt ORDER BY e, filed, accession, tr)""", "fcb")
fragment("fco", """SELECT *, nb >= 6 AND na >= 6 AND abs(value) > 0 AND (coalesce(len(lb), 0) >= 3 OR coalesce(len(la), 0) >= 3)
     AND (coalesce(len(lb), 0) < 3 OR abs(value) > lb[len(lb) // 2 + 1] * 50 OR abs(value) < lb[len(lb) // 2 + 1] / 50) AND (coalesce(len(la), 0) < 3 OR abs(value) > la[len(la) // 2 + 1] * 50 OR abs(value) < la[len(la) // 2 + 1] / 50) AS bad FROM fcn""", "fcn")
fragment("fc", "SELECT * FROM fco WHERE NOT bad", "fco")
fragment("kd", "SELECT DISTINCT company_id, concept, av AS d FROM fc WHERE ag = 'sum'", "fc")
fragment("kn", """SELECT k.company_id, k.concept, d, s, e, arg_max(value, (filed, -tr, accession)) AS value, arg_max(av, (filed, -tr, accession)) AS av FROM kd k JOIN fc f ON f.company_id = k.company_id AND f.concept = k.concept AND f.av <= k.d AND f.s IS NOT NULL GROUP BY ALL""", "kd", "fc")
fragment("sl", """SELECT * FROM (SELECT company_id, concept, d, coalesce(lag(e) OVER w, s) AS s, e, value - coalesce(lag(value) OVER w, 0) AS value, greatest(av, coalesce(lag(av) OVER w, av)) AS av, CASE WHEN lag(e) OVER w IS NULL THEN 1 ELSE 2 END AS na
   FROM kn WINDOW w AS (PARTITION BY company_id, concept, d, s ORDER BY e)) WHERE e - s BETWEEN 20 AND 400""", "kn")
fragment("se", "SELECT company_id, concept, d, e, arg_min({'s': s, 'v': value, 'av': av}, (e - s, na, value)) AS p FROM sl GROUP BY 1, 2, 3, 4", "sl")
fragment("tt", """WITH RECURSIVE ch AS (SELECT company_id, concept, d, e AS t, p.s AS cur, p.v AS total, 1 AS n, p.av AS av FROM se QUALIFY row_number() OVER (PARTITION BY company_id, concept, d ORDER BY e DESC) = 1
     UNION ALL SELECT c.company_id, c.concept, c.d, t, nx.p.s, total + nx.p.v, n + 1, greatest(c.av, nx.p.av) FROM ch c JOIN LATERAL (SELECT p FROM se x WHERE x.company_id = c.company_id AND x.concept = c.concept AND x.d = c.d AND x.e BETWEEN c.cur - 4 AND c.cur ORDER BY x.e DESC LIMIT 1) nx ON true WHERE t - cur < 350 AND n < 8)
   SELECT * FROM ch WHERE t - cur BETWEEN 350 AND 385""", "se")
fragment("ttm", """SELECT company_id, concept, 'ttm' AS basis, total AS value, t AS period_end, d AS available_at, n AS n_sources FROM (SELECT *, lag(t) OVER w AS lt, lag(total) OVER w AS lv FROM tt WINDOW w AS (PARTITION BY company_id, concept ORDER BY d)) WHERE lt IS DISTINCT FROM t OR lv IS DISTINCT FROM total""", "tt")
fragment("ins", """SELECT company_id, concept, 'instant' AS basis, value, e AS period_end, d AS available_at, 1 AS n_sources FROM (SELECT *, lag(e) OVER w AS le, lag(value) OVER w AS lv FROM (
     SELECT k.company_id, k.concept, d, max(f.e) AS e, arg_max(value, (f.e, filed, -tr, accession)) AS value FROM (SELECT DISTINCT company_id, concept, av AS d FROM fc WHERE s IS NULL) k JOIN fc f ON f.company_id = k.company_id AND f.concept = k.concept AND f.av <= k.d AND f.s IS NULL GROUP BY 1, 2, 3)
   WINDOW w AS (PARTITION BY company_id, concept ORDER BY d)) WHERE le IS DISTINCT FROM e OR lv IS DISTINCT FROM value""", "fc")
fragment("lev", """SELECT company_id, concept, 'quarter' AS basis, value, e AS period_end, d AS available_at, 1 AS n_sources FROM (SELECT *, lag(e) OVER w AS le, lag(value) OVER w AS lv FROM (
     SELECT company_id, concept, d, max(e) AS e, arg_max(value, (e, s)) AS value FROM (SELECT k.company_id, k.concept, d, s, e, arg_max(value, (filed, -tr, accession)) AS value FROM (SELECT DISTINCT company_id, concept, av AS d FROM fc WHERE ag = 'last' AND s IS NOT NULL) k
       JOIN fc f ON f.company_id = k.company_id AND f.concept = k.concept AND f.av <= k.d AND f.s IS NOT NULL GROUP BY 1, 2, 3, 4, 5) WHERE value > 0 GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY company_id, concept ORDER BY d)) WHERE le IS DISTINCT FROM e OR lv IS DISTINCT FROM value""", "fc")


def observations(t: Tables):
    qs = F.trunc("l_shipdate", "quarter")
    base = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("cik"), qs.alias("qs")).agg(cents("l_extendedprice").alias("rev"), F.sum("l_quantity").cast("double").alias("q"))
    from pyspark.sql import Window
    base = base.withColumns({"qe": F.last_day(F.add_months("qs", 2)), "ys": F.trunc("qs", "YEAR")})
    w = Window.partitionBy("cik", "ys").orderBy("qs").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumns({"ytd": F.sum("rev").over(w), "filed": F.date_add("qe", 30 + (F.col("cik") % 10).cast("int"))})
    c = F.col
    none = F.lit(None).cast("date")
    row = lambda ok, tag, unit, start, filed, value: F.when(ok, F.struct(F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), start.alias("period_start"), c("qe").alias("period_end"), filed.alias("filed"), value.alias("value")))
    yes = F.lit(True)
    broken = F.when((c("cik") % 17 == 5) & (F.month("qe") == 6), c("ytd") / 1000).otherwise(c("ytd"))
    rows = F.array(
        row(yes, "Revenues", "USD", c("ys"), c("filed"), broken),
        row(c("cik") % 4 == 1, "SalesRevenueNet", "USD", c("qs"), c("filed"), c("rev") * 0.99),
        row(c("cik") % 3 == 0, "Revenues", "USD", c("ys"), F.date_add("filed", 365), c("ytd") * 1.02),
        row(yes, "Assets", "USD", none, c("filed"), c("rev") * 2.5),
        row(c("cik") % 5 == 0, "Assets", "USD", none, F.date_add("filed", 90), c("rev") * 2.6),
        row(yes, "DilutedShares", "shares", c("qs"), c("filed"), c("q") * 1000),
        row(F.month("qe") > 3, "DilutedShares", "shares", c("ys"), c("filed"), c("q") * 900),
    )
    out = base.select("cik", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_r")).select("cik", "_r.*")
    accession = F.concat(F.lit("a"), c("cik").cast("string"), F.lit("-"), c("filed").cast("string"), F.lit("-"), c("tag"))
    return out.select(M.company_id("cik").alias("company_id"), "tag", "unit", "period_start", "period_end", "filed", F.date_add("filed", 1).alias("available_at"), "value", accession.alias("accession"))


def catalogue(t: Tables):
    return t.spark.createDataFrame(CATALOGUE, "concept string, tag string, unit string, tag_rank int, period_type string, aggregation string")


def facts(t: Tables):
    return P.map_tags(observations(t), catalogue(t)).withColumnsRenamed({"period_start": "start", "period_end": "end"})


def clean_facts(t: Tables):
    return cut_lineage(P.reject_scale_outliers(facts(t)))  # knowledge dates and known values both read it


@query("pit1_facts_for_concept", f"{{{{with fc0}}}} SELECT company_id, concept, s AS start, e AS \"end\", filed, accession, CAST(tr AS INTEGER) AS tag_rank, {R('value', 5)} AS value FROM fc0")
def _(t):
    return rounded(facts(t).select("company_id", "concept", "start", "end", "filed", "accession", "tag_rank", "value"), 5)


@query("pit2_scale_outliers", f"{{{{with fco}}}} SELECT company_id, concept, s AS start, e AS \"end\", filed, accession, bad AS scale_outlier FROM fco")
def _(t):
    return P.flag_scale_outliers(facts(t)).select("company_id", "concept", "start", "end", "filed", "accession", "scale_outlier")


@query("pit3_known_values", f"{{{{with kn}}}} SELECT company_id, concept, d AS as_of, s AS start, e AS \"end\", {R('value', 5)} AS value FROM kn")
def _(t):
    known = P.known_periods(clean_facts(t).where("aggregation = 'sum'"))
    return rounded(known.select("company_id", "concept", "as_of", "start", "end", "value"), 5)


@query("pit4_decompose", f"{{{{with sl}}}} SELECT company_id, concept, d AS as_of, s AS start, e AS \"end\", {R('value', 5)} AS value, av AS available_at FROM sl")
def _(t):
    known = P.known_periods(clean_facts(t).where("aggregation = 'sum'"))
    out = P.decompose(known, ["company_id", "concept", "as_of"])
    return rounded(out.select("company_id", "concept", "as_of", "start", "end", "value", "available_at"), 5)


@query("pit5_shortest_by_end", f"{{{{with se}}}} SELECT company_id, concept, d AS as_of, e AS \"end\", p.s AS start, {R('p.v', 5)} AS value FROM se")
def _(t):
    scope = ["company_id", "concept", "as_of"]
    known = P.known_periods(clean_facts(t).where("aggregation = 'sum'"))
    out = P.shortest_by_end(P.decompose(known, scope), scope)
    return rounded(out.select(*scope, "end", "start", "value"), 5)


@query("pit6_find_preceding", "{{with se}} SELECT a.company_id, a.concept, a.d AS as_of, a.e AS \"end\", max(b.e) AS preceding_end FROM se a JOIN se b ON a.company_id = b.company_id AND a.concept = b.concept AND a.d = b.d AND b.e BETWEEN a.p.s - 4 AND a.p.s GROUP BY 1, 2, 3, 4")
def _(t):
    scope = ["company_id", "concept", "as_of"]
    known = P.known_periods(clean_facts(t).where("aggregation = 'sum'"))
    out = P.preceding(cut_lineage(P.shortest_by_end(P.decompose(known, scope), scope)), scope)
    return out.select(*scope, "end", "preceding_end")


@query("pit12_catalogue", "{{with ob}} SELECT concept, tag, CAST(tr AS INTEGER) AS tag_rank, count(*) AS facts FROM ob JOIN (VALUES ('revenue', 'Revenues', 2), ('revenue', 'SalesRevenueNet', 3), ('assets', 'Assets', 0)) c(concept, tag, tr) USING (tag) GROUP BY 1, 2, 3")
def _(t):
    from panelstone.functions.concepts import catalogue as declared
    out = P.map_tags(observations(t), declared(t.spark))
    return out.groupBy("concept", "tag", "tag_rank").agg(F.count(F.lit(1)).alias("facts"))


@query("pit7_trailing_year", f"{{{{with tt}}}} SELECT company_id, concept, d AS as_of, t AS period_end, {R('total', 5)} AS value, n AS n_sources FROM tt")
def _(t):
    scope = ["company_id", "concept", "as_of"]
    out = P.trailing_year(P.decompose(P.known_periods(clean_facts(t).where("aggregation = 'sum'")), scope), scope)
    return rounded(out.select(*scope, "period_end", "value", "n_sources"), 5)


_SER = "company_id, concept, basis, {v} AS value, period_end, available_at, n_sources".format(v=R("value", 5))


@query("pit8_ttm_series", f"{{{{with ttm}}}} SELECT {_SER} FROM ttm")
def _(t):
    return rounded(P.ttm_series(clean_facts(t).where("aggregation = 'sum'")).drop("accessions", "is_derived"), 5)


@query("pit9_latest_level", f"{{{{with lev}}}} SELECT {_SER} FROM lev")
def _(t):
    return rounded(P.latest_level_series(clean_facts(t).where("aggregation = 'last' and period_type = 'duration'")).drop("accessions", "is_derived"), 5)


@query("pit10_instant_series", f"{{{{with ins}}}} SELECT {_SER} FROM ins")
def _(t):
    return rounded(P.instant_series(clean_facts(t).where("period_type = 'instant'")).drop("accessions", "is_derived"), 5)


@query("pit11_build_fundamentals", f"{{{{with ttm, lev, ins}}}} SELECT {_SER} FROM (SELECT * FROM ttm UNION ALL SELECT * FROM lev UNION ALL SELECT * FROM ins)")
def _(t):
    return rounded(P.build_fundamentals(cut_lineage(observations(t)), catalogue(t)).drop("accessions", "is_derived"), 5)


@query("ing3_revisions", """{{with ob}} SELECT company_id, tag, unit, period_start, period_end, filed, accession, CAST(row_number() OVER w - 1 AS INTEGER) AS revision, row_number() OVER w > 1 AND abs(value - first_value(value) OVER w) > abs(first_value(value) OVER w) * 1e-6 + 1e-6 AS is_restatement
   FROM ob WINDOW w AS (PARTITION BY company_id, tag, unit, period_start, period_end ORDER BY filed, accession)""")
def _(t):
    return P.assign_revisions(observations(t)).select("company_id", "tag", "unit", "period_start", "period_end", "filed", "accession", "revision", "is_restatement")


@query("ing4_fact_dedup", f"{{{{with ob}}}} SELECT company_id, tag, period_end, filed, {R('value', 5)} AS value FROM ob QUALIFY row_number() OVER (PARTITION BY company_id, tag, period_start, period_end ORDER BY filed DESC) = 1")
def _(t):
    return rounded(P.dedupe_facts(observations(t), ["company_id", "tag", "period_start", "period_end"], "filed").select("company_id", "tag", "period_end", "filed", "value"), 5)


@query("ing6_primary_concept", "{{with ob}} SELECT company_id, tag, period_end, filed, CASE tag WHEN 'Assets' THEN 'assets' WHEN 'DilutedShares' THEN 'shares_diluted' ELSE 'revenue' END AS concept FROM ob")
def _(t):
    return P.primary_concept(observations(t), catalogue(t)).select("company_id", "tag", "period_end", "filed", "concept")


@query("ing5_predecessors", """{{with ob}} SELECT company_id, tag, period_end, filed, 'own' AS source FROM ob UNION ALL SELECT 'cik' || lpad(CAST(CAST(substr(company_id, 4) AS BIGINT) + 1 AS VARCHAR), 10, '0'), tag, period_end, filed, 'predecessor' FROM ob WHERE CAST(substr(company_id, 4) AS BIGINT) % 10 = 0""")
def _(t):
    links = t.raw("supplier").where("s_suppkey % 10 = 0").select(M.company_id("s_suppkey").alias("predecessor_id"), M.company_id(F.col("s_suppkey") + 1).alias("successor_id"))
    return G.inherit_predecessors(observations(t), links).select("company_id", "tag", "period_end", "filed", "source")


@query("ing1_flatten_facts", f"{{{{with ob}}}} SELECT company_id, tag, unit, period_start, period_end, filed, {R('value', 5)} AS value, CAST(period_end - period_start AS INTEGER) AS duration_days FROM ob WHERE tag <> 'SalesRevenueNet' AND period_end <= filed AND (period_start IS NULL OR (period_end - period_start > 0 AND period_end - period_start <= 400))")
def _(t):
    # Each observation becomes its own nested facts document, then is flattened again.
    s = lambda x: F.col(x).cast("string")
    entry = F.struct(s("period_start").alias("start"), s("period_end").alias("end"), F.col("value").alias("val"), F.col("accession").alias("accn"), F.lit(None).cast("int").alias("fy"), F.lit(None).cast("string").alias("fp"), F.lit("10-Q").alias("form"), s("filed").alias("filed"))
    body = F.struct(F.create_map(F.col("unit"), F.array(entry)).alias("units"))
    docs = observations(t).select("company_id", F.to_json(F.create_map(F.lit("us-gaap"), F.create_map(F.col("tag"), body))).alias("facts"))
    out = G.flatten_facts(docs, "company_id", "facts", ["Revenues", "Assets", "DilutedShares"], ["USD", "shares"])
    return rounded(out.select("company_id", "tag", "unit", "period_start", "period_end", "filed", "value", "duration_days"), 5)


@query("ing16_coverage_by_concept", "{{with fc0}} SELECT concept, count(DISTINCT company_id) AS companies FROM fc0 GROUP BY 1")
def _(t):
    return G.coverage_by_concept(facts(t))


@query("qc2_thin_history", "{{with ob}} SELECT company_id, count(*) AS facts, min(filed) AS first_filed FROM ob GROUP BY 1 HAVING count(*) < 120 OR min(filed) > DATE '2001-11-01' - 730")
def _(t):
    from panelstone.operators import reports as Q
    return Q.thin_history(observations(t), F.lit("2001-11-01").cast("date"), 120)


@query("qc8_stale_filings", "{{with ob, co}} SELECT company_id, max(filed) AS last_filed, CAST(DATE '2002-06-01' - max(filed) AS INTEGER) AS age_days FROM ob WHERE company_id IN (SELECT company_id FROM co WHERE sector = 'ASIA') GROUP BY 1 HAVING DATE '2002-06-01' - max(filed) > 110")
def _(t):
    from panelstone.operators import reports as Q
    return Q.stale_filings(observations(t), t.companies.where("sector = 'ASIA'"), F.lit("2002-06-01").cast("date"), 110)


@query("rq6_financial_trend", f"""{{{{with fc}}}} SELECT company_id, concept, e AS period_end, {R('arg_max(value, (av, value))', 5)} AS value FROM fc GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY company_id, concept ORDER BY e DESC) <= 8""")
def _(t):
    from panelstone.operators import reports as Q
    f = clean_facts(t).select("company_id", "concept", F.col("end").alias("period_end"), "available_at", "value")
    return rounded(Q.financial_trend(f, 8), 5)


@query("rq8_freshness", "{{with fc0}} SELECT company_id, concept, max(av) AS latest, count(*) AS n, CAST(DATE '2003-01-01' - max(av) AS INTEGER) AS age_days FROM fc0 GROUP BY 1, 2")
def _(t):
    from panelstone.operators import reports as Q
    return Q.freshness(facts(t), F.lit("2003-01-01").cast("date"))


# ---- membership: a supplier is listed in a month's snapshot when it shipped at least six lines in it

fragment("sn", """SELECT 'T' || l_suppkey AS ticker, l_suppkey AS cik, CAST(last_day(l_shipdate) AS DATE) AS snapshot_date, CASE WHEN l_suppkey % 3 = 0 THEN DATE '1994-06-15' WHEN l_suppkey % 3 = 1 THEN CAST(last_day(l_shipdate) AS DATE) - 20 END AS date_added FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(*) >= 6""")
fragment("si", "SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS i, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS b, lead(snapshot_date) OVER (ORDER BY snapshot_date) AS a FROM (SELECT DISTINCT snapshot_date FROM sn)", "sn")
fragment("sp", """SELECT g.ticker, ea AS entry_observed_after, eb AS entry_observed_by, CASE WHEN st BETWEEN coalesce(ea, DATE '1900-01-01') AND eb OR (ea IS NULL AND st <= eb) THEN st END AS entry_date, CASE WHEN xb IS NOT NULL THEN lst END AS exit_observed_after, xb AS exit_observed_by, xb IS NULL AS still_member, CAST(k AS INTEGER) AS n_snapshots FROM (
   SELECT ticker, r, min(snapshot_date) AS eb, first(b ORDER BY i) AS ea, max(snapshot_date) AS lst, last(a ORDER BY i) AS xb, count(*) AS k FROM (SELECT sn.ticker, snapshot_date, i, a, b, i - row_number() OVER (PARTITION BY sn.ticker ORDER BY i) AS r FROM sn JOIN si USING (snapshot_date)) GROUP BY 1, 2) g
   JOIN (SELECT ticker, last(date_added ORDER BY snapshot_date) AS st FROM sn GROUP BY 1) s USING (ticker)""", "sn", "si")


def snapshots(t: Tables):
    k = F.col("l_suppkey")
    day = F.last_day("l_shipdate")
    base = t.raw("lineitem").groupBy("l_suppkey", day.alias("snapshot_date")).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 6")
    return base.select(F.concat(F.lit("T"), k.cast("string")).alias("ticker"), k.alias("cik"), "snapshot_date",
                       F.when(k % 3 == 0, F.lit("1994-06-15").cast("date")).when(k % 3 == 1, F.date_sub("snapshot_date", 20)).alias("date_added"))


_SP = ["ticker", "entry_observed_after", "entry_observed_by", "entry_date", "exit_observed_after", "exit_observed_by", "still_member", "n_snapshots"]


@query("sp1_build_spans", f"{{{{with sp}}}} SELECT {', '.join(_SP)} FROM sp")
def _(t):
    return M.build_spans(snapshots(t)).select(*_SP)


@query("sp2_latest_attributes", "{{with sn}} SELECT ticker, max(snapshot_date) AS snapshot_date, last(cik ORDER BY snapshot_date) AS cik FROM sn GROUP BY 1")
def _(t):
    s = snapshots(t).withColumn("seen", F.col("snapshot_date"))
    return M.latest_attributes(s, ["seen", "cik"]).select("ticker", F.col("seen").alias("snapshot_date"), "cik")


@query("grd8_sane_snapshots", "{{with sn}} SELECT ticker, snapshot_date FROM sn WHERE snapshot_date IN (SELECT snapshot_date FROM sn GROUP BY 1 HAVING count(*) >= (SELECT count(*) * 0.5 FROM supplier))")
def _(t):
    half = F.broadcast(t.raw("supplier").agg((F.count(F.lit(1)) * 0.5).alias("_h")))
    s = snapshots(t).join(half)
    thick = s.groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("_n"), F.max("_h").alias("_h")).where("_n >= _h").select("snapshot_date")
    return M.sane_snapshots(s.join(F.broadcast(thick), "snapshot_date", "left_semi"), 1).select("ticker", "snapshot_date")


fragment("cv", "SELECT ticker, min(date) AS pf, max(date) AS pl, CAST(count(*) AS INTEGER) AS n_bars FROM px GROUP BY 1", "px")
fragment("mb", """SELECT 'IDX' AS index_name, company_id AS security_id, company_id, sp.ticker, sector, industry, coalesce(sp.entry_date, entry_observed_by) AS entry_date, exit_observed_by AS exit_date, entry_observed_by, CASE WHEN sp.entry_date IS NOT NULL THEN 'exact' ELSE 'bracketed' END AS entry_precision,
   CASE WHEN still_member THEN 'still_member' ELSE 'bracketed' END AS exit_precision, still_member, n_snapshots, pf AS price_first, pl AS price_last FROM sp JOIN co USING (ticker) LEFT JOIN (SELECT cv.* FROM cv JOIN supplier ON ticker = 'T' || s_suppkey WHERE s_acctbal >= 0) c USING (ticker)""", "sp", "co", "cv")
fragment("mc", """SELECT *, CASE WHEN price_first IS NULL OR greatest(entry_date, (SELECT min(date) FROM px)) > least(coalesce(exit_date, DATE '2001-06-30'), DATE '2001-06-30') THEN 'none'
   WHEN price_first <= greatest(entry_date, (SELECT min(date) FROM px)) AND price_last >= least(coalesce(exit_date, DATE '2001-06-30'), DATE '2001-06-30') THEN 'full' ELSE 'partial' END AS price_coverage FROM mb""", "mb", "px")


def membership(t: Tables):
    spans = M.conservative_edges(M.build_spans(snapshots(t)))
    sold = t.raw("supplier").where("s_acctbal >= 0").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"))
    cover = M.price_coverage(t.prices).join(sold, "ticker", "left_semi")  # suppliers in debt stand for names without prices
    start = F.broadcast(t.sessions.agg(F.min("date").alias("_start")))
    out = spans.join(t.companies.select("company_id", "ticker", "sector", "industry"), "ticker").join(cover, "ticker", "left").join(start)
    end = F.lit("2001-06-30").cast("date")
    out = out.withColumns({"index_name": F.lit("IDX"), "security_id": F.col("company_id"), "price_coverage": M.classify_coverage("price_first", "price_last", "entry_date", "exit_date", F.col("_start"), end)})
    return out.withColumn("tradable", F.col("price_coverage") == "full").drop("_start")


@query("sp3_conservative_edges", "{{with mb}} SELECT ticker, entry_date, exit_date, entry_precision, exit_precision FROM mb")
def _(t):
    return M.conservative_edges(M.build_spans(snapshots(t))).join(t.companies.select("ticker"), "ticker").select("ticker", "entry_date", "exit_date", "entry_precision", "exit_precision")


@query("sp4_price_coverage", "{{with cv}} SELECT ticker, pf AS price_first, pl AS price_last, n_bars FROM cv")
def _(t):
    return M.price_coverage(t.prices)


@query("fn17_classify_coverage", "{{with mc}} SELECT ticker, entry_date, exit_date, price_coverage FROM mc")
def _(t):
    return membership(t).select("ticker", "entry_date", "exit_date", "price_coverage")


@query("sp5_share_classes", """{{with mc}}, x AS (SELECT *, 'G' || CAST(substr(ticker, 2) AS BIGINT) // 2 AS sid FROM mc) SELECT sid AS security_id, ticker, entry_observed_by, row_number() OVER (PARTITION BY index_name, sid, entry_observed_by ORDER BY CASE price_coverage WHEN 'full' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, n_snapshots DESC, ticker) = 1 AS is_primary FROM x""")
def _(t):
    grouped = membership(t).withColumn("security_id", F.concat(F.lit("G"), F.expr("cast(substring(ticker, 2, 12) as bigint) div 2").cast("string")))
    primary, other = M.collapse_share_classes(cut_lineage(grouped))
    return primary.withColumn("is_primary", F.lit(True)).transform(stacked, other.withColumn("is_primary", F.lit(False))).select("security_id", "ticker", "entry_observed_by", "is_primary")


fragment("ms0", """SELECT security_id, last(company_id ORDER BY entry_observed_by) AS company_id, last(ticker ORDER BY entry_observed_by) AS current_ticker, last(price_coverage ORDER BY entry_observed_by) AS price_coverage, min(entry_date) AS first_date, max(exit_date) AS lx, bool_or(still_member) AS still, max(price_last) AS price_last FROM mc GROUP BY 1""", "mc")


@query("sp6_sp7_master", """{{with ms0}}, d AS (SELECT *, CASE WHEN NOT still AND price_last < DATE '2001-11-01' - 14 THEN price_last END AS delisting_date FROM ms0) SELECT security_id, current_ticker, first_date, CASE WHEN NOT still THEN lx END AS last_date, delisting_date,
   CASE WHEN still THEN 'listed' WHEN delisting_date IS NOT NULL THEN 'delisted' ELSE 'unknown' END AS status, CASE price_coverage WHEN 'none' THEN 'no_prices' WHEN 'partial' THEN 'partial_prices' ELSE 'complete' END AS data_quality FROM d""")
def _(t):
    return M.build_master(membership(t), F.lit("2001-11-01").cast("date")).select("security_id", "current_ticker", "first_date", "last_date", "delisting_date", "status", "data_quality")


@query("sp8_ticker_changes", """{{with sn}}, s AS (SELECT cik // 4 AS cik, snapshot_date, min(ticker) AS ticker FROM sn GROUP BY 1, 2), c AS (SELECT *, CASE WHEN lag(ticker) OVER w <> ticker THEN 1 ELSE 0 END AS ch FROM s WINDOW w AS (PARTITION BY cik ORDER BY snapshot_date)),
   g AS (SELECT *, sum(ch) OVER (PARTITION BY cik ORDER BY snapshot_date) AS k FROM c), p AS (SELECT cik, k, min(ticker) AS ticker, min(snapshot_date) AS start_date FROM g GROUP BY 1, 2)
   SELECT cik, ticker, start_date, lead(start_date) OVER (PARTITION BY cik ORDER BY k) AS end_date, CASE WHEN k = 0 THEN 'initial' ELSE 'rename' END AS reason FROM p""")
def _(t):
    return M.ticker_changes(snapshots(t).withColumn("cik", F.expr("cik div 4")))


fragment("pa", """SELECT company_id AS security_id, ticker, 'split' AS action_type, date AS ex_date, split_ratio AS ratio, CAST(NULL AS DOUBLE) AS cash_amount FROM px JOIN co USING (ticker) WHERE split_ratio > 0 AND split_ratio <> 1
   UNION ALL SELECT company_id, ticker, 'dividend', date, NULL, dividend FROM px JOIN co USING (ticker) WHERE dividend > 0""", "px", "co")
fragment("ma", "SELECT security_id, ticker, 'index_entry' AS action_type, entry_date AS ex_date FROM mb UNION ALL SELECT security_id, ticker, 'index_exit', exit_date FROM mb WHERE exit_date IS NOT NULL", "mb")


@query("sp9_price_actions", f"{{{{with pa}}}} SELECT security_id, ticker, action_type, ex_date, {R('ratio')} AS ratio, {R('cash_amount')} AS cash_amount FROM pa")
def _(t):
    return rounded(M.price_actions(t.prices, t.companies.select("ticker", F.col("company_id").alias("security_id"))))


@query("sp10_membership_actions", "{{with ma}} SELECT security_id, ticker, action_type, ex_date FROM ma")
def _(t):
    return M.membership_actions(membership(t)).select("security_id", "ticker", "action_type", "ex_date")


@query("sp11_corporate_actions", "{{with pa, ma}} SELECT action_type, count(*) AS n, min(ex_date) AS first, max(ex_date) AS last FROM (SELECT security_id, action_type, ex_date FROM pa UNION ALL SELECT DISTINCT security_id, action_type, ex_date FROM ma) GROUP BY 1")
def _(t):
    out = M.corporate_actions(t.prices, membership(t), t.companies.select("ticker", F.col("company_id").alias("security_id")))
    return out.groupBy("action_type").agg(F.count(F.lit(1)).alias("n"), F.min("ex_date").alias("first"), F.max("ex_date").alias("last"))


@query("sp12_members_on", "{{with mc}} SELECT security_id, entry_date, exit_date FROM mc WHERE entry_date <= DATE '1999-03-15' AND (exit_date IS NULL OR exit_date > DATE '1999-03-15') AND price_coverage = 'full'")
def _(t):
    return M.members_on(membership(t), F.lit("1999-03-15").cast("date"), True).select("security_id", "entry_date", "exit_date")


_CR = ["securities", "spells", "member_months", "exits_observed", "removed_securities", "removed_with_prices", "removed_without_prices", "tradable_spells", "untradable_spells"]


@query("sp13_coverage_report", """{{with mc}} SELECT count(DISTINCT security_id) AS securities, count(*) AS spells, CAST(sum(n_snapshots) AS BIGINT) AS member_months, count(exit_date) AS exits_observed, count(DISTINCT CASE WHEN exit_date IS NOT NULL THEN security_id END) AS removed_securities,
   count(DISTINCT CASE WHEN exit_date IS NOT NULL AND price_coverage <> 'none' THEN security_id END) AS removed_with_prices, count(DISTINCT CASE WHEN exit_date IS NOT NULL AND price_coverage = 'none' THEN security_id END) AS removed_without_prices,
   count(*) FILTER (price_coverage = 'full') AS tradable_spells, count(*) FILTER (price_coverage <> 'full') AS untradable_spells FROM mc""")
def _(t):
    return M.coverage_report(membership(t)).select(*_CR)


@query("qc5_membership_gap", "{{with mc}} SELECT count(DISTINCT CASE WHEN exit_date IS NOT NULL AND price_coverage = 'none' THEN security_id END) AS removed_without_prices, count(DISTINCT CASE WHEN exit_date IS NOT NULL THEN security_id END) AS removed_securities FROM mc")
def _(t):
    return M.coverage_report(membership(t)).select("removed_without_prices", "removed_securities")


@query("sp14_build_identity", """SELECT p_brand AS company_id, CAST(p_partkey AS VARCHAR) AS ticker, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(CASE WHEN p_size > 10 THEN p_retailprice END, 0) DESC, CAST(p_partkey AS VARCHAR) DESC) = 1 AS is_primary, count(*) OVER (PARTITION BY p_brand) AS n_classes FROM part""")
def _(t):
    part = t.raw("part")
    listing = part.select(F.col("p_brand").alias("company_id"), F.col("p_partkey").cast("string").alias("ticker"))
    liquid = part.where("p_size > 10").select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_retailprice").alias("dollar_volume"))
    return M.build_identity(listing, liquid).select("company_id", "ticker", "is_primary", "n_classes")


@query("sp15_membership_windows", "{{with mc}} SELECT security_id, entry_date, exit_date, entry_precision, exit_precision FROM mc WHERE index_name = 'IDX' AND price_coverage <> 'none'")
def _(t):
    return membership(t).where("index_name = 'IDX' and price_coverage <> 'none'").select("security_id", "entry_date", "exit_date", "entry_precision", "exit_precision")


fragment("mod", "SELECT security_id, m.date, max(entry_date) AS entry_date, max(exit_date) AS exit_date FROM mb JOIN mend m ON entry_date <= m.date AND (exit_date IS NULL OR exit_date > m.date) GROUP BY 1, 2", "mb", "mend")


def months(t: Tables):
    from panelstone.operators.calendar import month_end_sessions
    return month_end_sessions(t.sessions)


@query("xs24_membership_on_dates", "{{with mod}} SELECT security_id, date, entry_date, exit_date FROM mod")
def _(t):
    return M.membership_on_dates(membership(t), months(t)).select("security_id", "date", "entry_date", "exit_date")


@query("jn7_interval_join", "{{with mod}} SELECT date, count(*) AS members FROM mod GROUP BY 1")
def _(t):
    return M.membership_on_dates(membership(t), months(t)).groupBy("date").agg(F.count(F.lit(1)).alias("members"))


@query("xs23_eligibility", f"""{{{{with mod, pan}}}} SELECT p.company_id AS security_id, p.date, {R('close_adj * 1.0')} AS price_as_traded, CASE WHEN m.security_id IS NULL THEN 'not_in_index' WHEN close_adj < 42 THEN 'below_min_price' WHEN market_cap < 5000 THEN 'below_min_liquidity' WHEN mom_12_1 IS NULL THEN 'insufficient_price_history' ELSE 'eligible' END AS eligibility
   FROM pan p LEFT JOIN mod m ON m.security_id = p.company_id AND m.date = p.date""")
def _(t):
    panel = t.panel.select(F.col("company_id").alias("security_id"), "date", F.col("close_adj").alias("close_raw"), F.lit(None).cast("double").alias("split_factor"), F.col("market_cap").alias("dollar_volume_median"), "mom_12_1")
    out = M.add_eligibility(panel, M.membership_on_dates(membership(t), months(t)), 42.0, 5000.0)
    return rounded(out.select("security_id", "date", "price_as_traded", "eligibility"))


@query("ag16_universe_sizes", f"""{{{{with pan}}}}, d AS (SELECT date, count(*) AS eligible, count(mom_12_1) AS scored FROM pan GROUP BY 1) SELECT {R('median(eligible)')} AS median_eligible, min(eligible) AS min_eligible, max(eligible) AS max_eligible, {R('median(scored)')} AS median_scored FROM d""")
def _(t):
    per = t.panel.groupBy("date").agg(F.count(F.lit(1)).alias("eligible"), F.count("mom_12_1").alias("scored"))
    return rounded(per.agg(F.median("eligible").alias("median_eligible"), F.min("eligible").alias("min_eligible"), F.max("eligible").alias("max_eligible"), F.median("scored").alias("median_scored")))


@query("sp16_holding_periods", f"""{{{{with pan}}}}, c AS (SELECT company_id, date FROM pan QUALIFY row_number() OVER (PARTITION BY date ORDER BY roic DESC, company_id) <= 20), i AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM c)),
   r AS (SELECT company_id, k - row_number() OVER (PARTITION BY company_id ORDER BY k) AS g FROM c JOIN i USING (date)), s AS (SELECT count(*) AS m FROM r GROUP BY company_id, g)
   SELECT {R('avg(m)')} AS mean_months, {R('median(m)')} AS median_months, max(m) AS max_months, count(*) AS n_spells, {R('avg(CASE WHEN m = 1 THEN 1.0 ELSE 0 END)')} AS share_single_month FROM s""")
def _(t):
    from panelstone.operators.portfolio import select_names
    held = select_names(t.panel, 20, score="roic", entity="company_id").select(F.col("company_id").alias("security_id"), F.col("date").alias("rebalance_date"))
    return rounded(M.holding_periods(cut_lineage(held)))


@query("ing12_judge_recovered", """{{with px, mb}}, x AS (SELECT ticker, min(entry_date) AS a, max(exit_date) AS b FROM mb WHERE exit_date IS NOT NULL GROUP BY 1), g AS (SELECT ticker, date, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS gap FROM px),
   j AS (SELECT ticker, a, b, min(date) AS f, max(date) AS l, count(*) FILTER (date BETWEEN a AND b) AS n, max(gap) AS mg FROM g JOIN x USING (ticker) GROUP BY 1, 2, 3) SELECT ticker, CASE WHEN f > b THEN 'reassigned' WHEN l < a THEN 'before_entry' WHEN n < 150 THEN 'too_few_sessions' WHEN mg > 32 THEN 'gap' ELSE 'accepted' END AS verdict, n AS sessions FROM j""")
def _(t):
    exits = membership(t).where("exit_date is not null").groupBy("ticker").agg(F.min("entry_date").alias("entry_date"), F.max("exit_date").alias("exit_date"))
    return G.judge_recovered(t.prices, exits, 150, 32).select("ticker", "verdict", "sessions")


@query("wn32_gap_detection", "{{with px}} SELECT ticker, date, CAST(date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS INTEGER) AS gap FROM px QUALIFY gap > 20")
def _(t):
    from pyspark.sql import Window
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy("ticker").orderBy("date")))
    return t.prices.select("ticker", "date", gap.alias("gap")).where("gap > 20")


@query("ing13_unknown_exits", "{{with mb}} SELECT ticker, max(entry_date) AS entry_date FROM mb WHERE exit_date IS NOT NULL AND ticker NOT IN (SELECT 'T' || s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def _(t):
    known = t.raw("supplier").where("s_acctbal > 5000").select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"))
    return G.unknown_exits(membership(t), known).select("ticker", "entry_date")


@query("ing14_former_members", "SELECT c_nationkey AS cik, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 0 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) GROUP BY 1")
def _(t):
    master = t.raw("customer").select(F.col("c_nationkey").alias("cik"), F.when(F.col("c_mktsegment") == "BUILDING", "listed").otherwise("delisted").alias("status"), F.when(F.col("c_acctbal") > 0, "full").otherwise("none").alias("price_coverage"))
    current = t.raw("supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("cik"))
    kept = G.former_members(master, current).select("cik")
    n = master.where("status <> 'listed' and price_coverage <> 'none'").groupBy("cik").agg(F.count(F.lit(1)).alias("n"))
    return kept.join(n, "cik")


# ---- estimates: users as companies, event types as metrics, event days as snapshots

fragment("es", """SELECT 'U' || user_id AS company_id, CAST(ts AS DATE) AS as_of, CASE event_type WHEN 'view' THEN 'eps' WHEN 'click' THEN 'revenue' END AS metric, CASE WHEN event_id % 2 = 0 THEN '0y' ELSE '+1y' END AS period, max(value) AS consensus, min(value) AS low, max(value) * 1.2 AS high,
   CASE WHEN user_id % 5 = 0 THEN max(value) / 1000 END AS growth, CAST(user_id % 9 AS INTEGER) AS n_analysts, CAST(user_id % 4 AS INTEGER) AS up_30d, CAST(user_id % 3 AS INTEGER) AS down_30d FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3, 4, user_id""")
fragment("esl", "SELECT * FROM es WHERE as_of = (SELECT max(as_of) FROM es)", "es")


def estimates(t: Tables):
    u = F.col("user_id")
    e = t.raw("events").where("event_type in ('view', 'click')")
    keys = [u, F.col("ts").cast("date").alias("as_of"), F.when(F.col("event_type") == "view", "eps").otherwise("revenue").alias("metric"), F.when(F.col("event_id") % 2 == 0, "0y").otherwise("+1y").alias("period")]
    out = e.groupBy(*keys).agg(F.max("value").alias("consensus"), F.min("value").alias("low"))
    return out.select(F.concat(F.lit("U"), u.cast("string")).alias("company_id"), "as_of", "metric", "period", "consensus", "low", (F.col("consensus") * 1.2).alias("high"), F.when(u % 5 == 0, F.col("consensus") / 1000).alias("growth"),
                      (u % 9).cast("int").alias("n_analysts"), (u % 4).cast("int").alias("up_30d"), (u % 3).cast("int").alias("down_30d"))


fragment("ev", """SELECT 'U' || user_id AS company_id, CAST(ts AS DATE) AS event_date, avg(value) AS actual_raw, max(value) * 0.8 AS estimate, count(*) AS n, CASE WHEN CAST(ts AS DATE) > DATE '2024-01-20' THEN NULL ELSE avg(value) END AS actual FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")
fragment("evn", "SELECT *, CASE WHEN abs(estimate) > 1e-9 AND actual IS NOT NULL THEN greatest(least((actual - estimate) / abs(estimate), 10), -10) END AS surprise, actual IS NULL AS is_future FROM ev", "ev")


def earnings(t: Tables):
    e = t.raw("events").where("event_type = 'purchase'").groupBy(F.col("user_id"), F.col("ts").cast("date").alias("event_date")).agg(F.avg("value").alias("_a"), (F.max("value") * 0.8).alias("estimate"))
    out = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("company_id"), "event_date", "estimate", F.when(F.col("event_date") <= F.lit("2024-01-20").cast("date"), F.col("_a")).alias("actual"))
    return ES.normalise_events(out)


TODAY = "2024-01-20"  # the day the estimate queries look from


@query("ing17_normalise_events", f"{{{{with evn}}}} SELECT company_id, event_date, {R('surprise')} AS surprise, is_future FROM evn")
def _(t):
    return rounded(earnings(t).select("company_id", "event_date", "surprise", "is_future"))


@query("ing17_normalise_estimates", f"""SELECT o_custkey, 'eps' AS metric, {R('max(o_totalprice)', 5)} AS consensus, {R('min(o_totalprice)', 5)} AS low FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'revenue', {R('avg(o_totalprice)', 5)}, NULL FROM orders GROUP BY 1""")
def _(t):
    wide = t.raw("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("eps_consensus"), F.min("o_totalprice").alias("eps_low"), F.avg("o_totalprice").alias("revenue_consensus"), F.lit(None).cast("double").alias("revenue_low"))
    return rounded(ES.normalise_estimates(wide, ["eps", "revenue"], ["o_custkey"]).select("o_custkey", "metric", "consensus", "low"), 5)


@query("es1_revision_balance", f"{{{{with esl}}}} SELECT company_id, {R('CASE WHEN up_30d + down_30d > 0 THEN (up_30d - down_30d) / (up_30d + down_30d) END')} AS eps_revision_3m FROM esl WHERE metric = 'eps' AND period = '+1y'")
def _(t):
    return rounded(ES.revision_balance(estimates(t)))


@query("es2_consensus_drift", f"""{{{{with es}}}}, o AS (SELECT * FROM es WHERE metric = 'revenue' AND period = '+1y'), m AS (SELECT max(as_of) AS d FROM o), p AS (SELECT company_id, arg_max(consensus, as_of) AS prior FROM o, m WHERE as_of <= d - 10 GROUP BY 1)
   SELECT o.company_id, {R('(consensus - prior) / abs(prior)')} AS revenue_revision_3m FROM o JOIN m ON o.as_of = d JOIN p USING (company_id)""")
def _(t):
    return rounded(ES.consensus_drift(estimates(t), lookback_days=10))


@query("es3_consensus_revenue", f"""{{{{with esl}}}}, a AS (SELECT company_id, consensus FROM esl WHERE metric = 'revenue' AND period = '0y'), b AS (SELECT * FROM esl WHERE metric = 'revenue' AND period = '+1y')
   SELECT coalesce(a.company_id, b.company_id) AS company_id, {R('CASE WHEN coalesce(n_analysts, 0) >= 3 THEN a.consensus END')} AS consensus_revenue_this_year, {R('CASE WHEN coalesce(n_analysts, 0) >= 3 THEN b.consensus END')} AS consensus_revenue_next_year, {R('CASE WHEN coalesce(n_analysts, 0) >= 3 THEN low END')} AS consensus_revenue_next_low,
   {R('CASE WHEN coalesce(n_analysts, 0) >= 3 THEN high END')} AS consensus_revenue_next_high, n_analysts AS n_revenue_analysts FROM a FULL JOIN b USING (company_id)""")
def _(t):
    return rounded(ES.consensus_revenue(estimates(t)))


@query("jn3_full_outer", f"""{{{{with esl}}}}, a AS (SELECT company_id, consensus FROM esl WHERE metric = 'eps' AND period = '0y'), b AS (SELECT company_id, consensus FROM esl WHERE metric = 'eps' AND period = '+1y') SELECT company_id, {R('a.consensus')} AS this_year, {R('b.consensus')} AS next_year FROM a FULL JOIN b USING (company_id)""")
def _(t):
    e = ES.latest_snapshot(estimates(t)).where("metric = 'eps'")
    side = lambda p, n: e.where(F.col("period") == p).select("company_id", F.col("consensus").alias(n))
    return rounded(side("0y", "this_year").join(side("+1y", "next_year"), "company_id", "full_outer"))


@query("es4_forward_growth", f"""{{{{with esl}}}}, a AS (SELECT company_id, consensus AS ty FROM esl WHERE metric = 'eps' AND period = '0y'), b AS (SELECT * FROM esl WHERE metric = 'eps' AND period = '+1y')
   SELECT b.company_id, {R('CASE WHEN n_analysts >= 3 THEN coalesce(growth, CASE WHEN abs(ty) > 1e-9 THEN consensus / ty - 1 END) END')} AS forward_eps_growth, {R('CASE WHEN n_analysts >= 3 THEN consensus END')} AS forward_eps, {R('ty')} AS consensus_eps_this_year, n_analysts FROM b LEFT JOIN a USING (company_id)""")
def _(t):
    return rounded(ES.forward_growth(estimates(t)))


fragment("sur", """SELECT company_id, avg(surprise) AS earnings_surprise, avg(CASE WHEN surprise > 0 THEN 1.0 ELSE 0.0 END) AS surprise_hit_rate FROM (SELECT * FROM evn WHERE NOT is_future AND surprise IS NOT NULL AND event_date <= DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC) <= 4) GROUP BY 1""", "evn")


@query("es5_earnings_surprise", f"{{{{with sur}}}} SELECT company_id, {R('earnings_surprise')} AS earnings_surprise, {R('surprise_hit_rate')} AS surprise_hit_rate FROM sur")
def _(t):
    return rounded(ES.earnings_surprise(earnings(t), F.lit(TODAY).cast("date")))


@query("ag5_last_k_mean", f"{{{{with sur}}}} SELECT company_id, {R('earnings_surprise')} AS last_four FROM sur")
def _(t):
    return rounded(ES.earnings_surprise(earnings(t), F.lit(TODAY).cast("date")).select("company_id", F.col("earnings_surprise").alias("last_four")))


@query("es6_next_earnings", "{{with ev}} SELECT company_id, min(event_date) AS next_earnings_date, CAST(min(event_date) - DATE '2024-01-20' AS INTEGER) AS days_to_earnings FROM ev WHERE event_date > DATE '2024-01-20' GROUP BY 1")
def _(t):
    return ES.next_earnings(earnings(t), F.lit(TODAY).cast("date"))


@query("rq9_next_catalyst", "SELECT 'U' || user_id AS company_id, arg_min(event_type, (CAST(ts AS DATE), event_type)) AS event_type, min(CAST(ts AS DATE)) AS event_date FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-25' GROUP BY 1")
def _(t):
    from panelstone.operators import reports as Q
    e = t.raw("events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("company_id"), F.col("ts").cast("date").alias("event_date"), "event_type")
    return Q.next_catalyst(e, F.lit("2024-01-25").cast("date")).select("company_id", "event_type", "event_date")


fragment("ped", f"""SELECT company_id, d AS last_earnings_date, p1 / p0 - m1 / m0 AS post_earnings_drift FROM (SELECT company_id, d, arg_max(CASE WHEN date <= d THEN close_adj END, CASE WHEN date <= d THEN date END) AS p0, arg_max(CASE WHEN date <= d THEN mc END, CASE WHEN date <= d THEN date END) AS m0,
   arg_max(CASE WHEN k BETWEEN 1 AND 3 THEN close_adj END, CASE WHEN k BETWEEN 1 AND 3 THEN date END) AS p1, arg_max(CASE WHEN k BETWEEN 1 AND 3 THEN mc END, CASE WHEN k BETWEEN 1 AND 3 THEN date END) AS m1 FROM (
     SELECT co.company_id, px.date, close_adj, mk.close AS mc, d, sum(CASE WHEN px.date > d THEN 1 ELSE 0 END) OVER (PARTITION BY co.company_id ORDER BY px.date) AS k FROM px JOIN co USING (ticker) JOIN (SELECT 'cik' || lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS company_id, max(CAST(l_shipdate AS DATE)) AS d FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate <= DATE '2000-06-01' GROUP BY 1) e ON e.company_id = co.company_id LEFT JOIN mk ON mk.date = px.date) GROUP BY 1, 2) WHERE p1 IS NOT NULL AND p0 IS NOT NULL""", "px", "co", "mk")


@query("es7_post_earnings_drift", f"{{{{with ped}}}} SELECT company_id, last_earnings_date, {R('post_earnings_drift')} AS post_earnings_drift FROM ped")
def _(t):
    ev = t.raw("lineitem").where("l_returnflag = 'R'").select(M.company_id("l_suppkey").alias("company_id"), F.col("l_shipdate").cast("date").alias("event_date"), F.lit(False).alias("is_future"))
    out = ES.post_earnings_drift(ev, t.prices.transform(stacked, t.market), t.companies, F.lit("2000-06-01").cast("date"), MARKET)
    return rounded(out.select("company_id", "last_earnings_date", "post_earnings_drift"))


@query("es8_estimate_metrics")
def _(t):
    companies = t.raw("events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("company_id")).distinct().withColumns({"is_primary": F.lit(True), "ticker": F.col("company_id")})
    px = t.raw("events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts").cast("date").alias("date")).agg((F.avg("value") + 10).alias("close_adj"))
    market = px.groupBy("date").agg(F.avg("close_adj").alias("close_adj")).select(F.lit(MARKET).alias("ticker"), "date", "close_adj")
    return rounded(ES.build_estimate_metrics(cut_lineage(estimates(t)), cut_lineage(earnings(t)), px.transform(stacked, market), companies, F.lit(TODAY).cast("date"), MARKET))


@query("qc7_snapshot_count", "{{with es}} SELECT count(DISTINCT as_of) AS snapshots, min(as_of) AS first, max(as_of) AS last FROM es")
def _(t):
    from panelstone.operators import reports as Q
    return Q.snapshot_count(estimates(t))


@query("grd7_revision_in_effect", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS as_of FROM events) SELECT as_of, (SELECT arg_max(event_id, ts) FROM events e WHERE e.event_type = 'signup' AND CAST(e.ts AS DATE) <= as_of) AS revision FROM d""")
def _(t):
    from panelstone.operators.asof import asof_backward
    ev = t.raw("events")
    dates = ev.select(F.col("ts").cast("date").alias("as_of")).distinct()
    # The last revision of each day, then as of each date: the unkeyed timeline holds days only.
    days = ev.where("event_type = 'signup'").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max_by("event_id", "ts").alias("revid"))
    return asof_backward(dates, days, [], "as_of", "day", {"revid": "revision"})
