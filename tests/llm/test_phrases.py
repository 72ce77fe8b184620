"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, most):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                counts.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    longest = Counter()
    for (lang, w), f in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                longest[lang, w[i : i + m]] = max(longest[lang, w[i : i + m]], f)
    scored = {}
    for (lang, w), a in found.items():
        if 100 * longest[lang, w] < 80 * a:
            s, _, left, right = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            scored.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, total[lang], -s) for lang, v in scored.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:most], 1))


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "of the", "new york city", "a\x01b", "a", "a\x00", "b", "É", "\x1c", "x" * 300, "in spite of", "|"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words[: rng.choice([4, 14])]) + rng.choice([" ", "  ", "\t", ". ", "\n", ",", "\r\x0b"] + [" "] * 9) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), (None, None), ("en", ""), ("en", " .. \n"), ("fr", "ha " * 20_000), rows[0], rows[0]]


@pytest.mark.parametrize("budget", [1 << 17, 300, 20, 1])
def test_matches_counting(spark, monkeypatch, budget):
    """With a small budget prefixes of one, two and three words are replaced by their extensions."""
    from panelstone.llm import phrases

    monkeypatch.setattr(phrases, "BUDGET", budget)
    rows = corpus(budget, 250)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert got(phrases.collocations(df, least=6, most=40)) == by_hand(rows, 6, 40)


def test_exact_beyond_64_bits(spark):
    """2,000,000 a passes 2^63 for the counts of a very large corpus."""
    from pyspark.sql import functions as F

    a, left, right = 9_007_199_254_740_993, 9_007_199_254_740_993, 9_007_199_254_740_999
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("l"), F.lit(right).alias("r"))
    from panelstone.llm.phrases import SCORE

    assert row.select(F.expr(SCORE)).first()[0] == 2_000_000 * a // (left + right)


def test_empty_table_and_clashing_names(spark):
    from panelstone.llm.phrases import collocations

    df = spark.createDataFrame([("en", "p q " * 40, 1, 2, 3)], "lang string, text string, w int, phrase int, f int")
    assert got(collocations(df)) == by_hand([("en", "p q " * 40)], 30, 2000)
    assert collocations(df.limit(0)).collect() == []
