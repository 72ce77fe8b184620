"""Ranked lexical search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    """All documents scored, with exact integers."""
    held = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    held = [(i, ws) for i, ws in held if ws]
    n_docs, total = len(held), sum(len(ws) for _, ws in held)
    df = {}
    for _, ws in held:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, ws in held:
            m = 10 + (90 * len(ws) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * ws.count(w)) // (1000 * ws.count(w) + 8 * m)) for w in terms if w in ws)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def corpus(rng, n):
    words = [f"W{i}" for i in range(60)] + ["été", "Ärger", "x1", "ǅ", "İ"]
    docs = [(i, rng.choice([", ", " ", "-"]).join(rng.choice(words[: rng.choice([6, 65])]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return docs + [(n + i, docs[3][1]) for i in range(15)] + [(7, docs[7][1]), (None, docs[5][1]), (n + 50, None), (n + 51, "!?"), (n + 52, "w1 " * 30_000)]


ITEMS = [(1, "w1 W2 w3 été ärger"), (2, "İ ǅ x1 w40 w40 w41"), (3, ""), (4, None), (None, "w1"), (5, "nowhere"), (6, "w5"), (6, "w6")]


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("limit", [200_000, 3])
def test_matches_full_scoring(spark, monkeypatch, limit):
    from panelstone.llm import lexical

    monkeypatch.setattr(lexical, "ITEM_TERM_ROWS", limit)  # 3: several searches, in blocks of items
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 7)
    docs = corpus(random.Random(3), 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(lexical.search(df, spark.createDataFrame(ITEMS, "item_id long, text string"))) == ranked(docs, ITEMS)


def test_intervals_close_whatever_the_stripe(monkeypatch):
    """The reading alone: small stripes stop early and still give the exact best."""
    from panelstone.llm import lexical

    rng = np.random.default_rng(4)
    for _ in range(200):
        n, terms, k = int(rng.integers(1, 60)), int(rng.integers(1, 8)), int(rng.integers(1, 6))
        held = rng.random((n, terms)) < 0.4
        tfs = rng.integers(1, 5, held.sum())
        ends = np.cumsum(held.sum(axis=1))
        weights, m = rng.integers(0, 4, terms), rng.integers(10, 30, n)
        monkeypatch.setattr(lexical, "STRIPE", int(rng.integers(1, 4)))
        searcher = lexical.Searcher([(1, np.arange(terms))], weights, k)
        searcher.block(list(range(n)), m, ends, np.nonzero(held)[1], tfs, m)
        gains = np.zeros((n, terms), dtype=np.int64)
        own, met = np.nonzero(held)
        gains[own, met] = weights[met] * ((10**9 * tfs) // (1000 * tfs + 8 * m[own]))
        want = sorted(((-int(s), i) for i, s in enumerate(gains.sum(axis=1)) if s > 0))[:k]
        assert [(-s, i) for s, _, i in searcher.best[1]] == want


def test_empty_tables_and_clashing_names(spark):
    from panelstone.llm.lexical import search

    docs, items = spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, item int, rank int"), spark.createDataFrame([(1, "a", 2)], "item_id long, text string, doc int")
    # One document, held by it: the weight floor(1000 ln(4 / 3)) = 287, m = 100.
    assert rows(search(docs, items)) == [(1, 1, 1, 287 * (10**9 // 1800))]
    assert search(docs.limit(0), items).collect() == [] and search(docs, items.limit(0)).collect() == []
