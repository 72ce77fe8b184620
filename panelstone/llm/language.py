"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence: the likelihood of the visible text under hashed letter-triple models, the language that the markup declares,
the suffix of the address, and what is known of the host. The models come from labelled documents (a bounded sample, ``TRAIN_ROWS``).
Reliability of declarations and priors of hosts are soft counts from grouped aggregation over all pages: a host's counts are smoothed
by its domain's, these by its suffix's, these by all pages'. A page's own count is taken out of its host before it is used.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstone.llm.common import arrow_map, pick, small_side, staged

TRAIN_ROWS, BUCKETS = 4000, 1 << 16
# Weight of one text against the other evidence: triples overlap, so their likelihoods are tempered.
TEMPER = 0.05
SMOOTH = 5.0
_HIDDEN = re.compile(r"<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"<[^<>]*>")
_ENTITY = re.compile(r"&#?\w{1,10};")
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.IGNORECASE)


def visible_text(html: str | None) -> str:
    return _ENTITY.sub(" ", _TAG.sub(" ", _HIDDEN.sub(" ", html or "")))


def declared_language(html: str | None) -> str | None:
    found = _DECLARED.search(html) if html else None
    return found.group(1).lower() if found else None


def host_of(url: str | None) -> tuple[str, str, str]:
    """Host, domain (last two labels) and suffix (last label); empty where there is none."""
    found = _HOST.match(url) if url else None
    host = found.group(1).lower().rstrip(".") if found else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def triple_counts(text: str | None) -> np.ndarray:
    """Hashed counts of letter triples of the lower-case text, runs of anything else being one space."""
    low = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not low:
        return np.zeros(BUCKETS)
    code = np.frombuffer(f" {low} ".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    key = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
    return np.bincount((key * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of triples, from at most ``rows`` labelled texts chosen by hash."""
    sample = pick(docs, text=text_col, lang=label_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ranked = sample.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(rows)
    sample = sample.withColumn("h", F.xxhash64("text")).join(F.broadcast(ranked), "h").dropDuplicates(["h"]).select("text", "lang")  # bounded by ``rows``

    def work(cols):
        total: dict[str, np.ndarray] = {}
        for text, lang in zip(cols["text"], cols["lang"], strict=True):
            total[lang] = total.get(lang, 0) + triple_counts(text)
        bucket = {x: np.flatnonzero(v) for x, v in total.items()}
        return {
            "lang": [x for x in total for _ in bucket[x]], "bucket": np.concatenate([bucket[x] for x in total]).astype(np.int32),
            "n": np.concatenate([total[x][bucket[x]] for x in total]).astype(np.int64),
        }

    counts = arrow_map(sample, work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # languages * buckets
    langs = sorted({r["lang"] for r in counts})
    table = np.full((BUCKETS, max(1, len(langs))), 0.5)
    for r in counts:
        table[r["bucket"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float64)


@lru_cache(maxsize=1)
def _cells(n: int) -> list[str]:
    return [f"t{i}" for i in range(n)]


def text_evidence(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``page_id, host, domain, suffix, declared, triples`` and the tempered log likelihoods ``like``."""
    langs, table = model
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(cols):
        out = {x: [] for x in ("page_id", "host", "domain", "suffix", "declared", "triples", "like")}
        for page_id, url, html in zip(cols["page_id"], cols["url"], cols["html"], strict=True):
            counts = triple_counts(visible_text(html))
            used = np.flatnonzero(counts)
            like = TEMPER * (counts[used] @ table[used]) if len(used) else np.zeros(len(langs))
            declared = declared_language(html)
            values = (page_id, *host_of(url), declared if declared in langs else "", int(counts.sum()), like - like.max() if len(like) else like)
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return out

    schema = f"page_id {kind}, host string, domain string, suffix string, declared string, triples long, like array<double>"
    return arrow_map(pages, work, schema, rows=64)


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, declared, text_lang, lang, probability`` for every row.

    ``text_lang`` is what the text alone says, null without letters; then the other evidence decides. A null page or address is one
    without that evidence. Ties go to the language first in the alphabet. Repeated rows repeat their results, null ids are carried,
    and an empty table, or a model without languages, gives no language.
    """
    langs, _ = model
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    told = staged(text_evidence(rows, model))
    if not langs:
        return told.select("page_id", "host", "declared", *[F.lit(None).cast("string").alias(x) for x in ("text_lang", "lang")], F.lit(None).cast("double").alias("probability"))
    weights = F.transform("like", lambda x: F.exp(x))
    soft = F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))
    told = told.withColumn("soft", soft)
    cells = [f"s{i}" for i in range(len(langs))]
    # A page without letters counts for no language. Sums are rounded, so the order of addition decides nothing.
    seen = told.where(F.col("triples") > 0).select("host", "domain", "suffix", "declared", *[F.round(F.col("soft")[i], 6).cast("decimal(18,6)").alias(c) for i, c in enumerate(cells)])
    total = lambda *by: seen.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in cells])

    def smoothed(counts: DataFrame, above: str | None, name: str) -> DataFrame:
        n = sum((F.col(c) for c in cells), F.lit(0.0))
        prior = [F.col(above)[i] if above else F.lit(1.0 / len(langs)) for i in range(len(langs))]
        return counts.withColumn(name, F.array(*[(F.col(c) + SMOOTH * p) / (n + SMOOTH) for c, p in zip(cells, prior, strict=True)]))

    everywhere = staged(smoothed(total(), None, "p_all").select("p_all")) if not seen.isEmpty() else told.sparkSession.createDataFrame([([1.0 / len(langs)] * len(langs),)], "p_all array<double>")
    suffixes = staged(smoothed(total("suffix").crossJoin(F.broadcast(everywhere)), "p_all", "p_suffix").select("suffix", "p_suffix"))  # one row
    domains = staged(smoothed(total("suffix", "domain").join(suffixes, "suffix"), "p_suffix", "p_domain").select("domain", "p_domain"))
    hosts = total("host").select("host", F.array(*cells).alias("seen"))
    # How often each declaration stands on pages of each language.
    marks = staged(total("declared"))
    sums = marks.agg(*[F.sum(c).alias(f"all_{c}") for c in cells])
    kinds = len(langs) + 1
    rates = F.array(*[F.log((F.col(c) + 1.0) / (F.col(f"all_{c}") + kinds)) for c in cells])
    marks = marks.crossJoin(F.broadcast(sums)).select("declared", rates.alias("mark"))  # languages + 1 rows against one

    # Domain and suffix are those of the page itself: a host without any text still has them.
    joined = told.join(small_side(staged(hosts), 100_000), "host", "left").join(small_side(domains, 100_000), "domain", "left").join(small_side(suffixes, 100_000), "suffix", "left")
    joined = joined.join(F.broadcast(marks), "declared", "left").crossJoin(F.broadcast(everywhere))
    own = lambda i: F.when(F.col("triples") > 0, F.col("soft")[i]).otherwise(0.0)
    left = [F.greatest(F.coalesce(F.col("seen")[i], F.lit(0.0)) - own(i), F.lit(0.0)) for i in range(len(langs))]
    base = [F.coalesce(F.col("p_domain")[i], F.col("p_suffix")[i], F.col("p_all")[i]) for i in range(len(langs))]
    n = sum(left, F.lit(0.0))
    prior = [F.log((x + SMOOTH * p) / (n + SMOOTH)) for x, p in zip(left, base, strict=True)]
    post = F.array(*[F.round(F.col("like")[i] + F.coalesce(F.col("mark")[i], F.lit(0.0)) + prior[i], 9) for i in range(len(langs))])
    out = joined.withColumn("post", post)
    names = F.array(*map(F.lit, langs))
    best = F.array_max("post")
    share = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    at = lambda x: F.element_at(names, F.array_position(x, F.array_max(x)).cast("int"))
    return out.select(
        "page_id", "host", F.when(F.col("declared") != "", F.col("declared")).alias("declared"), F.when(F.col("triples") > 0, at(F.col("like"))).alias("text_lang"),
        at(F.col("post")).alias("lang"), (F.lit(1.0) / share).alias("probability"),
    )
