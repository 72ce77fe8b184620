"""Normalising landed source data: nested facts, prices, snapshots, postings and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstone.functions.numeric import div
from panelstone.session import dealt, stacked

# taxonomy -> tag -> unit -> rows
FACT_ROWS = "array<struct<start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string>>"
FACTS_SCHEMA = f"map<string, map<string, struct<units: map<string, {FACT_ROWS}>>>>"
MAX_DURATION = 400


def flatten_facts(documents: DataFrame, entity: str, payload: str, tags: list[str], units: list[str]) -> DataFrame:
    """Nested company facts (JSON text or already a map) to one row per reported value, unusable rows dropped."""
    parsed = documents
    if dict(documents.dtypes)[payload] == "string":
        parsed = documents.withColumn(payload, F.from_json(payload, FACTS_SCHEMA))
    rows = (
        parsed.select(entity, F.explode(payload).alias("taxonomy", "_tags"))
        .select(entity, "taxonomy", F.explode("_tags").alias("tag", "_body"))
        .where(F.col("tag").isin(tags))
        .select(entity, "taxonomy", "tag", F.explode("_body.units").alias("unit", "_rows"))
        .where(F.col("unit").isin(units))
        .select(entity, "taxonomy", "tag", "unit", F.explode("_rows").alias("_r"))
    )
    day = lambda x: F.col(f"_r.{x}").try_cast("date")
    flat = rows.select(
        entity, "taxonomy", "tag", "unit", day("start").alias("period_start"), day("end").alias("period_end"), day("filed").alias("filed"),
        F.col("_r.val").alias("value"), F.col("_r.accn").alias("accession"), F.col("_r.fy").alias("fiscal_year"), F.col("_r.fp").alias("fiscal_period"), F.col("_r.form").alias("form"),
    )
    days = F.datediff("period_end", "period_start")
    usable = F.col("value").isNotNull() & F.col("period_end").isNotNull() & F.col("filed").isNotNull() & (F.col("period_end") <= F.col("filed"))
    sane = F.col("period_start").isNull() | ((days > 0) & (days <= MAX_DURATION))
    return flat.where(usable & sane).withColumns(
        {"duration_days": days, "period_type": F.when(F.col("period_start").isNull(), "instant").otherwise("duration")}
    )


def inherit_predecessors(observations: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of a predecessor re-keyed to its successor and added."""
    inherited = observations.join(links, observations["company_id"] == links["predecessor_id"]).select(
        *[F.col("successor_id").alias("company_id") if x == "company_id" else observations[x] for x in observations.columns],
        F.lit("predecessor").alias("source"),
    )
    return observations.withColumn("source", F.lit("own")).transform(stacked, inherited)


def judge_recovered(prices: DataFrame, exits: DataFrame, min_sessions: int = 20, max_gap: int = 45, lookback_days: int = 365) -> DataFrame:
    """Accept or reject price histories recovered for names that left: reassigned, stale, too short, or with holes.

    ``exits`` has ``ticker, entry_date, exit_date``. A history starting after the exit belongs to another company.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    joined = prices.select("ticker", "date").join(exits, "ticker").withColumn("_gap", F.datediff("date", F.lag("date").over(w)))
    inside = F.col("date").between(F.col("entry_date"), F.col("exit_date"))
    per = joined.groupBy("ticker", "entry_date", "exit_date").agg(
        F.min("date").alias("first_bar"), F.max("date").alias("last_bar"), F.count_if(inside).alias("sessions"), F.max("_gap").alias("largest_gap")
    )
    reason = (
        F.when(F.col("first_bar") > F.col("exit_date"), "reassigned")
        .when(F.col("last_bar") < F.col("entry_date"), "before_entry")
        .when(F.col("sessions") < min_sessions, "too_few_sessions")
        .when(F.coalesce("largest_gap", F.lit(0)) > max_gap, "gap")
        .otherwise("accepted")
    )
    return per.withColumn("verdict", reason)


def unknown_exits(membership: DataFrame, known: DataFrame) -> DataFrame:
    """Last spell of every ticker that left and is not among the known ones."""
    left = membership.where(F.col("exit_date").isNotNull()).join(known.select("ticker"), "ticker", "left_anti")
    return left.groupBy("ticker").agg(F.max_by(F.struct("entry_date", "exit_date"), "entry_date").alias("_l")).select("ticker", "_l.*")


def former_members(master: DataFrame, current: DataFrame) -> DataFrame:
    """Priced, identified former members that are not current ones, once per registrant."""
    kept = master.where(F.col("cik").isNotNull() & (F.col("price_coverage") != "none") & (F.col("status") != "listed"))
    return kept.join(current.select("cik"), "cik", "left_anti").dropDuplicates(["cik"])


def coverage_by_concept(fundamentals: DataFrame) -> DataFrame:
    return fundamentals.groupBy("concept").agg(F.countDistinct("company_id").alias("companies"))


def spread_bps(bid: str = "bid", ask: str = "ask") -> Column:
    """Quoted spread in basis points of the mid; null unless ask > bid > 0."""
    b, a = F.col(bid), F.col(ask)
    return F.when((a > b) & (b > 0), div(a - b, (a + b) / 2.0) * 1e4)


def normalise_postings(postings: DataFrame, dt: str) -> DataFrame:
    """All fields as text, a stable row id, one row per id."""
    fields = ["platform", "brand", "domain", "posting_id", "title", "location", "department", "url", "posted_at", "updated_at"]
    out = postings.select(*[F.col(x).cast("string").alias(x) if x in postings.columns else F.lit(None).cast("string").alias(x) for x in fields])
    by_id = F.to_json(F.struct("platform", "domain", "posting_id"))
    by_text = F.to_json(F.struct("platform", "domain", "title", "location"))
    row_id = F.sha2(F.when(F.col("posting_id").isNotNull(), by_id).otherwise(by_text), 256)
    out = out.withColumns({"dt": F.lit(dt), "row_id": row_id})
    # The smallest of a row id's copies, so the choice never depends on arrival order.
    rest = [x for x in out.columns if x != "row_id"]
    return out.groupBy("row_id").agg(F.min(F.struct(*rest)).alias("_r")).select("_r.*", "row_id")


def resolve_ticker(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Ticker by lower-case domain from a dictionary; confidence 1 when found, else 0."""
    known = dictionary.select(F.lower("domain").alias("domain"), F.upper("ticker").alias("ticker"))
    out = df.withColumn("domain", F.lower("domain")).join(known, "domain", "left")
    return out.withColumn("confidence", F.when(F.col("ticker").isNotNull(), 1.0).otherwise(0.0))


def _grams(text: str, sizes: list[int]) -> Column:
    """Distinct substrings of the given sizes; a text shorter than a size has none of it."""
    cut = lambda n: F.when(
        F.length(text) >= n, F.transform(F.sequence(F.lit(0), F.length(text) - n), lambda i: F.substr(F.col(text), i + 1, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[cut(n) for n in sizes]))


def resolve_names(df: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Company by exact lower-case name, otherwise by a name contained in its aliases.

    The registry has ``company_name``, ``aliases`` and ``ticker``; of several companies that fit the smallest ticker counts. Containment
    is resolved over the distinct names only: aliases are posted under their substrings of up to three characters, a name looks up the
    rarest of its own and what it finds there is verified. An empty name is contained in every alias, a null name in none.
    """
    names = df.select(F.lower(name).alias("_n")).distinct()
    reg = registry.select(F.lower("company_name").alias("_c"), F.lower("aliases").alias("_a"), F.upper("ticker").alias("_t"))
    exact = names.join(reg.groupBy("_c").agg(F.min("_t").alias("_x")), F.col("_n") == F.col("_c"), "left").select("_n", "_x")
    rest = exact.where("_x is null").select("_n")
    postings = reg.where(F.col("_a").isNotNull()).groupBy("_a").agg(F.min("_t").alias("_t")).select("_a", "_t", F.explode(_grams("_a", [0, 1, 2, 3])).alias("_g"))
    counts = postings.groupBy("_g").agg(F.count(F.lit(1)).alias("_k"))
    own = F.when(F.length("_n") >= 3, _grams("_n", [3])).otherwise(F.array("_n"))
    asked = rest.where(F.col("_n").isNotNull()).select("_n", F.explode(own).alias("_g")).join(counts, "_g", "left")
    rarest = asked.groupBy("_n").agg(F.min(F.struct(F.coalesce("_k", F.lit(0)).alias("_k"), "_g")).alias("_r")).where("_r._k > 0").select("_n", F.col("_r._g").alias("_g"))
    alias = rarest.join(postings, "_g").where(F.col("_a").contains(F.col("_n"))).groupBy("_n").agg(F.min("_t").alias("_y"))
    found = exact.join(alias, "_n", "left").select("_n", F.coalesce("_x", "_y").alias("resolved_ticker"))
    return df.withColumn("_n", F.lower(name)).join(found, "_n", "left").drop("_n")


def posting_counts(resolved: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Postings per (ticker, dt) as long feature rows."""
    kept = resolved.where(F.col("ticker").isNotNull() & (F.col("confidence") >= min_confidence))
    return kept.groupBy("ticker", "dt").agg(F.count(F.lit(1)).alias("value")).select("ticker", "dt", F.lit("job_postings").alias("feature_id"), "value")


def bars_to_signals(bars: DataFrame, source: str) -> DataFrame:
    """One bar to its price, volume and range-volatility signal rows, each under a stable id."""
    def row(kind: str, field: str, value: Column, meta: dict) -> Column:
        entries = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]) if meta else F.create_map().cast("map<string,string>")
        uid = F.sha2(F.concat_ws("|", F.lit(source), "ticker", F.col("date").cast("string"), F.lit(kind), F.lit(field)), 256)
        return F.struct(uid.alias("uid"), F.lit(kind).alias("kind"), value.cast("double").alias("value"), entries.alias("meta"))

    spread = div(F.col("high") - F.col("low"), "close")
    cells = F.array(
        row("market.price", "close", F.col("close"), {"field": "close"}),
        row("market.volume", "volume", F.col("volume"), {}),
        row("market.volatility", "rng_close", spread, {"formula": "range/close"}),
    )
    out = bars.select(F.col("ticker").alias("entity"), F.col("date").alias("asof"), F.explode(cells).alias("_s"), F.lit(source).alias("source"))
    return out.select("_s.uid", "entity", "asof", "_s.kind", "_s.value", "source", "_s.meta").where(F.col("value").isNotNull())


def dedupe_signals(signals: DataFrame, sequence: tuple[str, ...] = (), near: bool = False) -> DataFrame:
    """One row per uid, the last by the columns of ``sequence``; what they leave equal is settled by all values.

    The choice among structs sorts its rows, so they are dealt by uid first, into parts that grow in number with the input. An id that
    is the hexadecimal text of some bytes travels as these bytes. ``near``: the rows are dealt by some of their columns already, so those
    that are equal in everything become one where they lie, before any is moved.
    """
    rest = [x for x in signals.columns if x != "uid"]
    orders = [*sequence, *[x for x in rest if x not in sequence]]
    data = F.unhex("uid")
    exact = F.coalesce(F.lower(F.hex(data)) == F.col("uid"), F.lit(False))
    packed = signals.select(F.when(exact, data).alias("_b"), F.when(~exact, F.col("uid")).alias("_t"), *rest)
    kinds = dict(packed.dtypes)
    if near and not any(k.startswith(("map", "struct", "array")) for k in kinds.values()):
        # Grouping takes -0.0 for 0.0: a double comes back as one of its rows had it.
        doubles = [x for x in rest if kinds[x] in ("double", "float")]
        packed = packed.groupBy(*packed.columns).agg(F.count(F.lit(1)).alias("_n"), *[F.first(x).alias(f"_{x}") for x in doubles])
        packed = packed.select("_b", "_t", *[F.col(f"_{x}" if x in doubles else x).alias(x) for x in rest])
    packed = dealt(packed, "_b", "_t")
    if "meta" in rest:
        best = F.max_by(F.struct(*rest), F.struct(*[F.to_json(x) if x == "meta" else F.col(x) for x in orders]))
    else:
        best = F.max(F.struct(*orders))
    out = packed.groupBy("_b", "_t").agg(best.alias("_r"))
    return out.select(F.coalesce(F.lower(F.hex("_b")), "_t").alias("uid"), "_r.*").select(*signals.columns)
