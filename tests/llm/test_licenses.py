"""Licences: containment against sets in Python, unknown licences and prose, negation, odd tables."""

import random
import re

import pytest

UNSEEN = ["foo public license", "zoo license 2 0", "gnu free documentation license", "house rules", "tea ceremony license version 3", "terms of a contract", "qpl"]
PROSE = [
    "the book is distributed under the terms of the agreement between us", "distributed under the terms of a contract", "no licence at all", "permission to land was granted to the crew",
    "the software is as good as the hardware", "a copy of the work of the author", "version 2 0 of the work", "all copies were distributed",
]


def naive(text, templates):
    """Best containment by family, from own features kept as Python sets."""
    from panelstone.llm.licenses import COMMON

    def runs(words):
        return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1) if not set(words[i : i + n]) <= COMMON}

    holders = {}
    for family, t in templates:
        for r in runs(t.split()):
            holders.setdefault(r, set()).add(family)
    here, best = runs(re.findall(r"[^\W_]+", text.lower())), {}
    for family, t in templates:
        own = {r for r in runs(t.split()) if len(holders[r]) == 1}
        if own:
            best[family] = max(best.get(family, 0.0), len(own & here) / len(own))
    return best


@pytest.fixture(scope="module")
def scanned(spark):
    """One scan over noise, notices, parts of notices, unknown licences and prose."""
    from panelstone.llm.licenses import FORMS, NAMES, PASSAGES, TEMPLATES, scan_licenses

    rng = random.Random(8)
    noise = [f"w{i}" for i in range(50)] + ["the", "of", "software", "this", "license"]
    filler = lambda: " ".join(rng.choice(noise) for _ in range(rng.randint(0, 12)))
    texts = [(f"{filler()} {t} {filler()}", f) for f, t in TEMPLATES]
    parts = []
    for f, t in PASSAGES:
        w = t.split()
        a = rng.randint(0, len(w) // 2)
        parts.append((" ".join(w[a : a + rng.randint(3, len(w))]), f))
    unknown = [form.format(f"the {name}") for name in UNSEEN for form in FORMS] + PROSE
    unknown += [f"not licensed under {n}" for names in NAMES.values() for n in names[:1]] + ["This isn't released under the MIT License, nor will it be."]
    everything = [t for t, _ in texts + parts] + unknown + [filler() for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(everything)), "doc_id long, text string")
    return texts, parts, unknown, everything, scan_licenses(df).collect()


def test_whole_notices_get_their_family_only(scanned):
    texts, _, _, _, rows = scanned
    for i, (text, family) in enumerate(texts):
        assert {r.family for r in rows if r.doc_id == i and r.confirmed} == {family}, text


def test_similarity_is_containment(scanned):
    from panelstone.llm.licenses import CONTAINED, TEMPLATES

    _, _, _, everything, rows = scanned
    for r in rows:
        if "not licensed" not in everything[r.doc_id]:
            best = naive(everything[r.doc_id], TEMPLATES)
            assert r.similarity == pytest.approx(best[r.family]) and r.confirmed == (best[r.family] >= CONTAINED)
            assert r.probability >= 0.5


def test_unknown_licences_prose_and_negations_give_nothing(scanned):
    texts, parts, unknown, everything, rows = scanned
    start = len(texts) + len(parts)
    assert [(everything[r.doc_id], r.family) for r in rows if start <= r.doc_id < start + len(unknown)] == []


def test_parts_of_notices_name_no_other_family(scanned):
    texts, parts, _, _, rows = scanned
    named = {(r.doc_id - len(texts), r.family) for r in rows if len(texts) <= r.doc_id < len(texts) + len(parts) and r.confirmed}
    assert all(parts[i][1] == f for i, f in named) and len(named) > len(parts) / 4


def test_several_licences_in_a_line(spark):
    from panelstone.llm.licenses import scan_licenses

    rows = [(1, "dual licensed under the GPL and the MIT License"), (2, "licensed under the Apache License, Version 2.0, licensed under CC BY-NC 4.0, released under the zlib license")]
    got = {(r.doc_id, r.family) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.confirmed}
    assert got == {(1, "gpl"), (1, "mit"), (2, "apache"), (2, "cc-by-nc"), (2, "zlib")}


def test_clashing_names_and_empty_tables(spark):
    from panelstone.llm.licenses import scan_licenses

    odd = "doc_id long, text string, runs int, family int, best int, p int, at int, features struct<`odd name`:int>"
    df = spark.createDataFrame([(1, "Released under the MIT License.", 1, 2, 3, 4, 5, (6,)), (None, None, 1, 2, 3, 4, 5, None)], odd)
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in scan_licenses(df).collect()] == [(1, 0, "mit", True)]
    assert scan_licenses(df.limit(0)).collect() == []
    assert scan_licenses(spark.createDataFrame([(1, None), (2, ""), (3, "\n\n")], "doc_id long, text string")).collect() == []
