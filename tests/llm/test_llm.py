"""Operators against brute force, round trips, held-out rows, and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Random texts with exact copies, near copies and a shared passage."""
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    passage = prose(rng, 50)
    for i in range(8):
        texts.append(f"{prose(rng, 20)} {passage} {prose(rng, 30)}")
        base = texts[i].split()
        base[len(base) // 2] = "changed"
        texts += [texts[i], " ".join(base)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and white texts, a very long word, a very long text, ties, repeated rows, clashing names."""
    long = "a" * 20_000 + " " + "ha " * 3000
    rows = [(1, "", "x", 1), (2, None, None, None), (None, None, "x", 2), (3, " \t\n", "x", 3), (4, "one", "x", 4), (4, "one", "x", 4), (5, long, "y", 5), (6, long, "y", 6), (None, "one", None, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long")


def jaccard_components(texts, width):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_all_pairs(spark, corpus, width):
    from panelstone.llm.minhash import drop_near_duplicates, near_duplicates

    df = spark.createDataFrame(corpus, "doc_id long, text string")
    want = jaccard_components(corpus, width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=width).collect()}
    assert got == want
    assert {r.doc_id for r in drop_near_duplicates(df, width=width).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_dense_star_of_near_copies(spark):
    """Many variants of one text, some linked only past their head."""
    from panelstone.llm.minhash import near_duplicates

    rng = random.Random(5)
    base = prose(rng, 60).split()
    texts = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(30)}"
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=2).collect()} == jaccard_components(texts, 2)


def test_near_copies_that_are_no_links_are_not_paired(spark, monkeypatch):
    """Pairs formed past the heads grow with what may be linked, not with the square of a star."""
    from panelstone.llm import minhash

    rng = random.Random(7)
    base = prose(rng, 120).split()
    texts = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.choice([2, 4, 9, 14, 18])):
            own[rng.randrange(len(own))] = f"edit{rng.randrange(6)}"
        texts.append((i, " ".join(own)))
    met = []
    stacked = minhash.stacked

    def counted(top, other, **k):
        if top.columns == ["x", "m"]:
            met.append(top.count())
        return stacked(top, other, **k)

    monkeypatch.setattr(minhash, "stacked", counted)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width=2).collect()} == jaccard_components(texts, 2)
    assert met and sum(met) < 10 * len(texts)


def test_sketches_never_differ_more_than_sets():
    from panelstone.llm.minhash import sketch

    rng = np.random.default_rng(3)
    for words in (1, 5, 16):
        for size in (0, 1, 40, 2000):
            a, b = (np.unique(rng.integers(-50_000, 50_000, size)) for _ in range(2))
            low = sum(int(x).bit_count() for x in (sketch(a, words) ^ sketch(b, words)).view(np.uint64))
            assert len(sketch(a, words)) == words and low <= len(np.setxor1d(a, b))


def test_repeats_match_windows(spark, corpus):
    from panelstone.llm.recompression import remove_repeats

    window = 12
    words = {i: t.split() for i, t in corpus}
    words[1000] = ["ha"] * 40  # one long run repeats itself
    places = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            places.setdefault(tuple(w[k : k + window]), []).append((i, k))
    gone = {(i, k + j) for found in places.values() if len(found) > 1 for i, k in found for j in range(window)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "doc_id long, text string")
    for r in remove_repeats(df, window=window).collect():
        left = [w for k, w in enumerate(words[r.doc_id]) if (r.doc_id, k) not in gone]
        assert (r.n_words, r.n_removed) == (len(words[r.doc_id]), len(words[r.doc_id]) - len(left))
        assert r.kept_sha256 == hashlib.sha256(" ".join(left).encode()).hexdigest()


SAMPLES = ["", " ", "  two", "it's  a\n\nb <|endoftext|>x", "a.\nb c,", "x" * 500, "žluť kůň \u0085 \x1c é1½", "\n \n", "😀 ok\t\t!"]


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    from panelstone.llm.packing import Encoder
    from panelstone.llm.token_counts import TOKENIZER, BytePairCounter, tokenizer_path

    path = tokenizer_path(TOKENIZER)
    own, counter, encoder = Tokenizer.from_file(path), BytePairCounter(path), Encoder(path)
    rng = random.Random(2)
    for text in SAMPLES + ["".join(rng.choice(" \n\tab'slé1_.<|endoftext|>　‍") for _ in range(rng.randint(0, 12))) for _ in range(3000)]:
        ids = own.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(ids)
        assert encoder.encode(text) == np.array(ids, dtype="<u4").tobytes()


def test_overlong_white_runs_have_the_same_ids():
    from tokenizers import Tokenizer

    from panelstone.llm.packing import LONG_SPACE, Encoder
    from panelstone.llm.token_counts import TOKENIZER, tokenizer_path

    path = tokenizer_path(TOKENIZER)
    own, encoder = Tokenizer.from_file(path), Encoder(path)
    k, rng = LONG_SPACE, random.Random(6)
    texts = [" " * 2_000_000, " " * 1_100_000 + "a", "a" + "\n" * 1_100_000 + "b"]
    for run in (" " * k, " " * (k - 1), "\n" * k, "\n \t" * k, "\u2003\u3000\xa0" * k, "\x1c" * k, " " * k + "\x1f", "\t" * k + " "):
        texts += [run, f"a{run}", f"{run}b", f"x's{run}'s y", f"1{run}<|endoftext|>{run}2", f"<|endoftext|>{run}", f".{run}.{run}é {run}"]
    for _ in range(40):
        texts.append("".join(rng.choice(["a", "1", ".", "'s", " ", "\n", "<|endoftext|>", " " * k, "\n" * k, " \n" * k]) for _ in range(6)))
    for text in texts:
        assert encoder.encode(text) == np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), (text[:20], len(text))


def test_packing_is_gapless_and_whole(spark, corpus):
    from panelstone.llm.packing import encoder, pack
    from panelstone.llm.token_counts import TOKENIZER, tokenizer_path

    own, sequence = encoder(tokenizer_path(TOKENIZER)), 128
    rows = pack(spark.createDataFrame(corpus, "doc_id long, text string"), sequence=sequence).collect()
    end = np.array([1], dtype="<u4").tobytes()
    for i, text in corpus:
        ids = own.encode(text) + end
        parts = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert [s for s, _, _ in parts] == list(np.cumsum([0, *[n for _, n, _ in parts]])[:-1]) and sum(n for _, n, _ in parts) * 4 == len(ids)
        assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == c for s, n, c in parts)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= sequence and sum(used.values()) / (len(used) * sequence) > 0.95


def test_plan_uses_every_piece_once():
    from panelstone.llm.packing import plan

    rng = random.Random(3)
    for _ in range(20):
        histogram = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        cover = {x: [] for x in histogram}
        for length, lo, hi, _base, _offset in plan(histogram, 64):
            cover[length].append((lo, hi))
        for length, n in histogram.items():
            flat = sorted(cover[length])
            assert flat[0][0] == 0 and flat[-1][1] == n and all(a[1] == b[0] for a, b in zip(flat, flat[1:], strict=False))


def test_personal_data_spans():
    import re

    from panelstone.llm.pii import all_spans, emails, mask

    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@@-_ é") for _ in range(rng.randint(0, 25)))
        assert emails(text) == [m.span() for m in pattern.finditer(text)]
    cases = {
        "mail jo.doe [at] mail [dot] com now": "mail [email] now", "write to ann at site dot org ok": "write to [email] ok", "look at the dot there": "look at the dot there",
        "ｊｏｅ＠ｍａｉｌ．ｃｏｍ": "[email]", "jоe@mail.com": "[email]", "call plus four nine one seven zero one two three four five six": "call [phone]",
        "card 4111 1111 1111 1111.": "card [card].", "card ４１１１ １１１１ １１１１ １１１１.": "card [card].", "1.2.3.4 300.1.1.1": "[ip] 300.1.1.1", "4111 1111 1111 1112": "4111 1111 1111 1112",
    }
    assert {k: mask(k) for k in cases} == cases
    base, every = all_spans("x ann at site dot org +1 (456) 555-2186")
    assert base == [(22, 39, "phone")] and (2, 21, "email") in every and set(base) <= set(every)


def test_personal_data_with_one_mark_spelled_any_case_and_all_digits():
    from panelstone.llm.pii import all_spans, mask

    whole = [
        "jo@mail [dot] com", "jo@mail[.]com", "jo@mail dot com", "jo@mail.co dot uk", "jo@mail dot co dot uk", "jo [AT] mail [DOT] com", "jo(At)mail(Dot)com", "jo At mail Dot Com",
        "jo[@]mail.com", "jo AT mail(dot)com", "jo@mail {.} com",
    ]
    assert {t: mask(f"to {t}, ok") for t in whole} == {t: "to [email], ok" for t in whole}
    numbers = ["10[.]0[.]0[.]1", "10 dot 0 dot 0 dot 1", "10.0[.]0(DOT)1", "10 [.] 0 Dot 0.1"]
    assert {t: mask(f"at {t} now") for t in numbers} == {t: "at [ip] now" for t in numbers}
    spelled = [
        "plus vier neun eins sieben null eins zwei drei vier fünf sechs", "plus trois trois un zéro deux quatre cinq six sept huit neuf", "PLUS VIER NEUN EINS SIEBEN NULL EINS ZWEI DREI VIER FÜNF SECHS",
        "plus tres cuatro nueve uno cero dos cinco seis siete ocho nueve", "plus trois trois un ze\u0301ro deux quatre cinq six sept huit neuf",
    ]
    assert {t: mask(f"x {t} y") for t in spelled} == {t: "x [phone] y" for t in spelled}
    same = ["look at the Dot there", "300[.]1[.]1[.]1", "1 dot 2 dot 3", "un deux trois", "we met @ noon dot done", "a (.) b", "jo[.]com"]
    assert {t: mask(t) for t in same} == {t: t for t in same}
    # A plain address ends where it ends.
    assert mask("jo@mail.com dot the end") == "[email] dot the end" and mask("jo@mail dot com dot the end") == "[email] dot the end"
    base, every = all_spans("a jo@mail[.]com 10[.]0[.]0[.]1")
    assert base == [] and every == [(2, 15, "email"), (16, 30, "ip")]


def test_nearest_recall_and_ties(spark):
    from panelstone.llm.permutation_index import nearest

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32).astype(float)
    x[500:1500] = x[500]  # a third of all rows share one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 32), (9200, [float("nan")] * 32), (9300, [1.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found, hits = {}, 0
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert sorted(found) == list(range(0, 3000, 100))
    for q, near in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hits += len(set(want) & {i for _, i in near})
        assert near == sorted(near) and len(near) == 10
        assert all(abs(s - d[i]) < 1e-12 for s, i in near)
    assert [i for _, i in found[600]] == list(range(500, 510))
    assert hits >= 0.9 * 10 * len(found)


def test_contamination(spark):
    from panelstone.llm.decontamination import contamination, drop_contaminated

    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(14, 40))) for k in range(30)] + [(90, "tiny item"), (91, None), (92, "")]
    docs = [(i, prose(rng, 120)) for i in range(40)]
    for i in range(10):
        docs[i] = (i, f"{prose(rng, 30)} {items[i][1].upper()}\n{prose(rng, 30)}")
    docs += [(100, "a Tiny ITEM here"), (101, None), (102, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contamination(d, b).collect()}
    assert got == {**{(i, i): 1.0 for i in range(10)}, (100, 90): 1.0}
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == {i for i, _ in docs} - set(range(10)) - {100}


def test_licenses(spark):
    from panelstone.llm.licenses import scan_licenses

    rng = random.Random(9)
    docs = [(i, f"{prose(rng, 20)}\n{prose(rng, 20)}") for i in range(50)]
    docs += [(100, "x\nLicensed under the Apache License, Version 2.0."), (101, "Released under the MIT License."), (102, "the license of the house"), (103, None)]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {(100, 1): ("apache", True), (101, 0): ("mit", True)}


def test_wrapped_licenses_and_two_in_a_line(spark):
    from panelstone.llm.licenses import scan_licenses

    gpl = "you may know\n# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License\n\nend"
    apache = "Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an \"AS IS\" BASIS"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    rows = [(1, gpl), (2, apache), (3, bsd), (4, two), (5, two), (5, two), (6, "Licensed under CC BY-NC 4.0."), (7, f"{two}\n{apache}\n{two}"), (None, bsd), (8, "a b"), (9, None)]
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.confirmed)
    both = lambda i, k: [(i, k, "apache"), (i, k, "mit")]
    assert got == sorted([(0, 0, "bsd"), (1, 1, "gpl"), (2, 0, "apache"), (3, 0, "bsd"), (6, 0, "cc-by-nc"), *both(4, 0), *both(5, 0) * 2, *both(7, 0), (7, 1, "apache"), *both(7, 3)])


HELD_OUT = {
    "Copyright 2021 Ann Smith. All Rights Reserved.": "proprietary", "This project is available under the MIT license": "mit", "Licensed under the GNU Affero General Public License v3.0": "agpl",
    "This file is distributed under the terms of the GNU Lesser General Public License": "lgpl", "The code is published under the ISC License.": "isc", "Source released under the zlib license": "zlib",
    "It is licensed under the Eclipse Public License 2.0": "epl", "This tool is free and unencumbered software released into the public domain.": "unlicense", "Everything here is licensed under Apache 2.0": "apache",
    "Text is licensed under CC BY-SA 4.0": "cc-by-sa", "This library is free software; you can redistribute it under the terms of the GNU General Public License version 2": "gpl",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies": "isc",
}


def test_reworded_notices_of_all_families(spark):
    from panelstone.llm.licenses import scan_licenses

    rows = list(enumerate(HELD_OUT)) + [(100, "the rights of all reserved seats"), (101, "unlike a license of the house")]
    got = {}
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.confirmed:
            got.setdefault(r.doc_id, set()).add(r.family)
    assert got == {i: {family} for i, family in enumerate(HELD_OUT.values())}


def test_language_fusion(spark):
    from panelstone.llm.language import identify, train

    docs = spark.createDataFrame([("the house and the garden of the king " * 5, "en"), ("das haus und der garten des königs " * 5, "de")], "text string, lang string")
    pages = [(i, f"http://a.example.de/{i}", '<html lang="de"><script>the the</script><p>das haus und der garten</p></html>') for i in range(5)]
    pages += [(10, "http://b.example.com", '<html lang="en"><p>the garden of the king</p></html>'), (11, "http://a.example.de/x", None), (12, None, None), (13, None, "<p>the house of the king</p>")]
    got = {r.page_id: r for r in identify(spark.createDataFrame(pages, "page_id long, url string, html string"), train(docs)).collect()}
    assert [got[i].lang for i in (0, 10, 11, 13)] == ["de", "en", "de", "en"] and got[11].text_lang is None and len(got) == len(pages)


def test_empty_page_takes_the_language_of_its_domain_and_suffix(spark):
    from panelstone.llm.language import identify, train

    docs = spark.createDataFrame([("the house and the garden of the king " * 5, "en"), ("das haus und der garten des königs " * 5, "de")], "text string, lang string")
    pages = [(i, f"http://a{i}.example.de/", "<p>das haus und der garten des königs</p>") for i in range(5)]
    pages += [(10 + i, f"http://a{i}.example.com/", "<p>the house and the garden of the king</p>") for i in range(20)]
    pages += [(50, "http://new.example.de/", ""), (51, "http://new.other.de/", None), (52, "http://new.example.com/", ""), (53, None, None)]
    got = {r.page_id: r.lang for r in identify(spark.createDataFrame(pages, "page_id long, url string, html string"), train(docs)).collect()}
    assert [got[i] for i in (50, 51, 52, 53)] == ["de", "de", "en", "en"]


def test_toxicity_grammar():
    from panelstone.llm.toxicity import DEFAULT, SEED_INSULTS, Model, text_score

    model = Model(tuple((w, True, x) for w, x in SEED_INSULTS.items()), tuple(DEFAULT))
    at = lambda t: text_score(model, t)
    assert at("you are an idiot.") > at("an idiot.") > at("they said idiot.") > at("a fine day") == at("") == at(None)
    assert at("you are not an idiot.") < at("you are an idiot.") and at("I will kill you") > at("kill the lights") and at("idiotic idiots") == at("")


def test_odd_rows_and_empty_tables(spark, odd):
    from panelstone.llm import decontamination, language, licenses, minhash, packing, pii, recompression, token_counts, toxicity

    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "one"), (None, None)], "item_id long, text string")
    per_row = {
        "tokens": lambda d: token_counts.token_counts(d), "near": lambda d: minhash.near_duplicates(d), "repeats": lambda d: recompression.remove_repeats(d),
        "pii": lambda d: pii.find_pii(d), "masked": lambda d: pii.mask_pii(d), "toxic": lambda d: toxicity.score(d, toxicity.train(d, labels)),
    }
    for name, fn in per_row.items():
        assert fn(odd).count() == odd.count(), name
        assert fn(odd.limit(0)).count() == 0, name
    assert packing.pack(odd).groupBy("sequence_id").count().count() > 0 and packing.pack(odd.limit(0)).count() == 0
    assert decontamination.contamination(odd, bench).count() == 3 and decontamination.contamination(odd.limit(0), bench.limit(0)).count() == 0
    assert licenses.scan_licenses(odd).count() == 0
    pages = odd.selectExpr("doc_id as page_id", "key as url", "text as html", "n as host")
    for d in (pages, pages.limit(0)):
        assert language.identify(d, language.train(odd.withColumnRenamed("key", "lang"))).count() == d.count()
    near = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert {(1, 1, True), (2, 2, True), (4, 4, True), (None, 4, False), (6, 5, False)} <= near


def test_pipeline_stages(spark, tmp_path, corpus):
    """Every stage's decisions hold on its own input: documents with columns kept, clean ones kept."""
    import corpus_pipeline

    rng = random.Random(21)
    clean = [(i, prose(rng, 80), "en", "s", 1) for i in range(40)]
    item = prose(rng, 30)
    planted = [(100, f"you idiot, you are a worthless moron. {prose(rng, 30)} you stupid loser", "en", "s", 1), (101, clean[0][1], "en", "s", 1), (102, f"{prose(rng, 9)} {item} {prose(rng, 9)}", "en", "s", 1), (103, f"{prose(rng, 40)} a.b@mail.com", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(clean + planted, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append({r.doc_id for r in docs.collect()})
    everything = {i for i, *_ in clean + planted}
    assert kept == [everything - {100}, everything - {100, 101}, everything - {100, 101, 102}, everything - {100, 101, 102}]
    assert docs.where("doc_id = 103").first().text.endswith("[email]")
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept[-1])
