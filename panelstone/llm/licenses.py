"""Licence notices by a trained paragraph classifier. DataFrame and MLlib functions only.

Features of a paragraph are the word pairs and triples that occur in the templates of one family only, its *own* ones, and are not made
of common words alone; "licensed under the" is nobody's. A multinomial logistic regression, fitted on templates, on parts of them, and on
an unknown class (other licences in the same forms, shuffled templates, paragraphs of the corpus), names the family of a paragraph. How
likely it is a known licence at all is calibrated by a second, one-dimensional regression on held-out paragraphs.
A template of the named family confirms it if the paragraph holds most of the template's own features; a family the classifier does not
name is never confirmed. Once a family is confirmed its own features are taken out and the rest is judged again, so a line that names
several licences gets each. Paragraphs are single lines, and blocks of neighbouring lines, as notices are often wrapped.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstone.llm.common import pick, staged
from panelstone.session import stacked

UNKNOWN = "unknown"
# Distinct corpus paragraphs taken, on average, as examples of the unknown class: those of the least hashes.
NEGATIVES = 2000
# Part of a template's own features that a confirmed paragraph must hold, and of any template that an unknown example may hold.
CONTAINED, APART = 0.6, 0.3
# Least calibrated probability of the named family.
BELIEVED = 0.5

# Fixed values. Names as notices give them, put into the usual forms of a notice.
NAMES = {
    "apache": ("the apache license version 2 0", "the apache license", "apache 2 0"),
    "mit": ("the mit license", "mit license"),
    "isc": ("the isc license", "isc license"),
    "zlib": ("the zlib license", "the zlib libpng license"),
    "unlicense": ("the unlicense",),
    "gpl": ("the gnu general public license", "the gnu general public license version 2", "the gnu general public license version 3", "the gnu gpl", "the gpl", "gplv2", "gplv3"),
    "lgpl": ("the gnu lesser general public license", "the gnu lesser general public license version 2 1", "the gnu lesser general public license version 3", "the gnu lgpl", "the lgpl", "lgplv3"),
    "agpl": ("the gnu affero general public license", "the gnu affero general public license version 3", "the gnu agpl", "the agpl", "agplv3"),
    "bsd": ("the bsd license", "the bsd 2 clause license", "the bsd 3 clause license", "a bsd style license"),
    "mpl": ("the mozilla public license", "the mozilla public license version 2 0", "mpl 2 0"),
    "epl": ("the eclipse public license", "the eclipse public license version 2 0", "the eclipse public license v1 0", "epl 2 0"),
    "cc-by": ("cc by 4 0", "a creative commons attribution 4 0 international license", "the creative commons attribution license"),
    "cc-by-sa": ("cc by sa 4 0", "a creative commons attribution sharealike 4 0 international license", "the creative commons attribution sharealike license"),
    "cc-by-nc": ("cc by nc 4 0", "a creative commons attribution noncommercial 4 0 international license", "the creative commons attribution noncommercial license"),
}
# Other licences and things, put into the same forms: examples of the unknown class.
OTHERS = (
    "the wtfpl", "the artistic license", "the artistic license 2 0", "the boost software license version 1 0", "the beerware license", "the cddl", "the common development and distribution license version 1 1",
    "the european union public licence", "eupl 1 2", "the sil open font license version 1 1", "the python software foundation license", "the postgresql license", "the ncsa open source license", "the microsoft public license",
    "the academic free license version 3 0", "the openssl license", "the php license version 3 01", "the ruby license", "the vim license", "the sleepycat license", "the server side public license", "the business source license 1 1",
    "a commercial license", "a proprietary license", "a custom license", "an open source license", "a contract", "the agreement between us", "the contract", "this agreement", "the following conditions", "version 2 0", "license", "the same license",
    "the license", "the public license", "a free license", "our license version 3", "the international license", "the terms of use", "the new york sky", "embargo", "pressure", "construction",
)
FORMS = ("licensed under {}", "released under {}", "this work is licensed under {}", "distributed under the terms of {}")
# Standard headers, and the short licences whole, a template for each paragraph that no other family has.
PASSAGES = (
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "this notice may not be removed or altered from any source distribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("public-domain", "this work is dedicated to the public domain"),
    ("public-domain", "to the extent possible under law the author has waived all copyright and related rights"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission"),
    ("proprietary", "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("proprietary", "this software is proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited"),
)
TEMPLATES = tuple((family, form.format(name)) for family, names in NAMES.items() for name in names for form in FORMS) + PASSAGES
COMMON = frozenset("a an and any are as at by for from has have in is it may of on or that the this to under was with you your 0 1 2 3 4".split())


# "Not licensed under ..." and the eight words that follow.
NEGATED = r"(?:\bnot|\bnever|n['’]t)\s+(?:licensed|released|distributed|available|covered|published)\s+under\b(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+){0,8}"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, without what is negated."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), NEGATED, " "), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def word_runs(ws: Column, n: int) -> Column:
    size = F.greatest(F.size(ws) - (n - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice(ws, F.lit(k + 1), size).alias(f"w{k}") for k in range(n)])
    return F.transform(parts, lambda g: F.concat_ws(" ", *[g[f"w{k}"] for k in range(n)]))


def features(ws: Column) -> Column:
    return F.concat(word_runs(ws, 2), word_runs(ws, 3))


def vocabulary(templates: tuple[tuple[str, str], ...]) -> tuple[list[str], list[str]]:
    """Features in use, and the words of which every one of them holds at least one."""
    runs = {" ".join(t[i : i + n]) for _, text in templates for t in [text.split()] for n in (2, 3) for i in range(len(t) - n + 1)}
    runs = sorted(r for r in runs if not set(r.split()) <= COMMON)
    return runs, sorted({w for r in runs for w in r.split()} - COMMON)


def own_features(templates: tuple[tuple[str, str], ...]) -> dict[str, list[str]]:
    """Features by the only family whose templates hold them."""
    families: dict[str, set[str]] = {}
    for family, text in templates:
        for run in vocabulary(((family, text),))[0]:
            families.setdefault(run, set()).add(family)
    out: dict[str, list[str]] = {f: [] for f, _ in templates}
    for run, held in sorted(families.items()):
        if len(held) == 1:
            out[min(held)].append(run)
    return out


def paragraphs(df: DataFrame, id_col: str, text_col: str, markers: list[str]) -> DataFrame:
    """``doc_id, uid, block, alone, at, ws``: every line with a marker word, and every block of several lines.

    A block is as many neighbouring lines as have a marker or common words only. ``uid`` and ``block`` (its first line, from 0) name it
    among the rows; ``alone`` tells a line from a block, ``at`` gives the line of each word.
    """
    marked = lambda ws: F.exists(ws, lambda w: w.isin(markers))
    joins = lambda ws: marked(ws) | ((F.size(ws) > 0) & F.forall(ws, lambda w: w.isin(sorted(COMMON))))
    rows = pick(df, doc_id=id_col, text=text_col).where(F.col("text").isNotNull())
    rows = rows.select("doc_id", F.transform(F.split("text", "\n"), words).alias("lines"))
    rows = rows.select("doc_id", "lines", F.transform("lines", joins).alias("joins"), F.monotonically_increasing_id().alias("uid")).where(F.array_contains("joins", True))
    edge = lambda step: F.filter(F.transform("joins", lambda x, i: F.when(x & ~F.coalesce(F.get("joins", i + step), F.lit(False)), i)), lambda i: i.isNotNull())
    spans = F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"))
    cut = F.transform(spans, lambda x: F.struct(x["first"].alias("block"), F.slice("lines", x["first"] + 1, x["last"] - x["first"] + 1).alias("own")))
    blocks = rows.select("doc_id", "uid", F.explode(cut).alias("b")).select("doc_id", "uid", "b.*")
    at = lambda ws, line: F.array_repeat(line, F.size(ws))
    whole = F.struct(F.lit(False).alias("alone"), F.flatten(F.transform("own", lambda ws, i: at(ws, F.col("block") + i))).alias("at"), F.flatten("own").alias("ws"))
    each = F.transform("own", lambda ws, i: F.struct(F.lit(True).alias("alone"), at(ws, F.col("block") + i).alias("at"), ws.alias("ws")))
    made = blocks.select("doc_id", "uid", "block", F.explode(F.when(F.size("own") > 1, F.concat(each, F.array(whole))).otherwise(each)).alias("p"))
    return made.select("doc_id", "uid", "block", "p.*").where(marked(F.col("ws")))


def counted(df: DataFrame, runs: list[str]) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(runs, inputCol="runs", outputCol="features").transform(df)


def vectors(df: DataFrame, runs: list[str]) -> DataFrame:
    return counted(df.withColumn("runs", F.array_distinct(F.filter(features(F.col("ws")), lambda x: x.isin(runs)))), runs)


def known_templates(spark: SparkSession, templates: tuple[tuple[str, str], ...], families: list[str]) -> DataFrame:
    """``family, whole``: the own features of each template; a fixed small table."""
    own = own_features(templates)
    rows = [(families.index(f), [r for r in vocabulary(((f, text),))[0] if r in set(own[f])]) for f, text in templates]
    return spark.createDataFrame([r for r in rows if r[1]], "family int, whole array<string>").distinct()


def examples(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """``label, ws, held``: templates and their parts of at least two thirds, and other licences; a third of the parts is held out."""
    families = {f: i + 1 for i, f in enumerate(sorted({f for f, _ in templates}))}
    rows = [(float(families[f]), i, text) for i, (f, text) in enumerate(templates)]
    rows += [(0.0, len(rows) + i, form.format(name)) for i, (name, form) in enumerate((n, f) for n in OTHERS for f in FORMS)]
    base = spark.createDataFrame(rows, "label double, template int, text string").withColumn("ws", F.split("text", " "))
    cuts = base.withColumn("from", F.explode(F.sequence(F.lit(0), F.floor(F.size("ws") / 3).cast("int"))))
    cuts = cuts.withColumn("length", F.explode(F.array(*[F.ceil(F.size("ws") * x).cast("int") for x in (0.67, 0.8, 1.0)])))
    cuts = cuts.where(F.col("from") + F.col("length") <= F.size("ws"))
    held = (F.col("length") < F.size("ws")) & (F.pmod(F.xxhash64("template", "from", "length"), F.lit(3)) == 0)
    return cuts.select("label", F.expr("slice(ws, `from` + 1, length)").alias("ws"), held.alias("held")).distinct()


class Classifier:
    """The fitted regression, its families, and the calibration of what it says."""

    def __init__(self, corpus: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, negatives: int = NEGATIVES):
        """``corpus``: paragraphs with ``ws``. Distinct ones below a hash that admits ``negatives`` on average, and that hold next to
        nothing of any template, are examples of the unknown class, whatever words they use."""
        spark = corpus.sparkSession
        self.families = [UNKNOWN, *sorted({f for f, _ in templates})]
        self.own = own_features(templates)
        self.runs = sorted(r for own in self.own.values() for r in own)
        self.known = known_templates(spark, templates, self.families)
        h = F.xxhash64("ws")
        share = min(1.0, negatives / max(corpus.agg(F.approx_count_distinct(h)).first()[0], 1))
        sample = vectors(corpus.select("ws").where(F.shiftrightunsigned(h, 11) < int(share * 2**53)).distinct(), self.runs)
        parts = self.known.select("whole", F.explode("whole").alias("run"))
        near = sample.select("ws", F.explode("runs").alias("run")).join(F.broadcast(parts), "run").groupBy("ws", "whole").count()
        plain = sample.join(near.where(F.col("count") >= F.size("whole") * APART), "ws", "left_anti")
        third = F.pmod(F.xxhash64("ws", F.lit(1)), F.lit(3)) == 0
        told = examples(spark, templates)
        # Template words out of order, so that single pairs do not suffice.
        told = told.unionByName(told.select(F.lit(0.0).alias("label"), F.expr("reverse(ws)").alias("ws"), "held"))
        told = vectors(told.unionByName(plain.select(F.lit(0.0).alias("label"), "ws", third.alias("held"))), self.runs)
        # A part of a notice without an own feature tells no family.
        told = staged(told.where((F.col("label") == 0) | (F.size("runs") > 0)).select("label", "features", "held").coalesce(1))  # some thousand rows
        # Every family weighs the same, and the unknown class as much as five of them, however many examples there are.
        sizes = told.where(~F.col("held")).groupBy("label").count()
        weighed = told.where(~F.col("held")).join(F.broadcast(sizes), "label").withColumn("weight", F.when(F.col("label") == 0, 5.0).otherwise(1.0) / F.col("count"))
        self.model = LogisticRegression(maxIter=60, regParam=0.0005, elasticNetParam=0.0, family="multinomial", weightCol="weight").fit(weighed)
        self.slope, self.shift = 1.0, 0.0
        seen = self.judge(told.where("held")).select((F.col("label") > 0).cast("double").alias("label"), array_to_vector(F.array("margin")).alias("features"))
        fit = LogisticRegression(regParam=0.01, elasticNetParam=0.0).fit(seen)
        self.slope, self.shift = float(fit.coefficients[0]), float(fit.intercept)

    def judge(self, df: DataFrame) -> DataFrame:
        """Add the likeliest family, its log odds against unknown, and the calibrated probability that it is a known one."""
        names = [x for x in df.columns if x not in ("rawPrediction", "probability", "prediction")]
        out = self.model.transform(df).select(*names, vector_to_array("probability").alias("p"))
        known = F.slice("p", 2, len(self.families))
        out = out.withColumn("best", F.array_position(known, F.array_max(known)).cast("int"))
        margin = F.log(F.greatest(F.array_max(known), F.lit(1e-300))) - F.log(F.greatest(F.get("p", F.lit(0)), F.lit(1e-300)))
        sure = 1.0 / (1.0 + F.exp(-(F.col("margin") * self.slope + self.shift)))
        return out.withColumn("margin", margin).withColumn("probability", sure).drop("p")


UNIT = ["uid", "block", "alone", "at"]


def named_families(model: Classifier, units: DataFrame) -> DataFrame:
    """Units with the family that the classifier names and believes, and how far a template of it confirms that."""
    named = model.judge(units).where(F.col("probability") >= BELIEVED)
    met = named.join(F.broadcast(model.known), F.col("best") == F.col("family")).withColumn("found", F.array_intersect("whole", "runs"))
    return met.groupBy("doc_id", *UNIT, "ws", "runs", "family", "probability").agg(F.max(F.size("found") / F.size("whole")).alias("similarity"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed`` for every paragraph with a believed licence family.

    ``family`` is what the classifier names, ``probability`` the calibrated chance that it is a known licence, ``similarity`` the largest part of a
    template's own features that the paragraph holds; from 0.6 the family is confirmed. ``paragraph`` is a line, from 0: the notice, or
    where one wrapped over several lines begins. A line gets every family that it confirms, or else the one believed; a block of lines
    adds the families that none of its lines confirms, and takes the place of the only line that does if it holds more. Licences
    without a template are unknown and give no row. A notice negated in its own line ("not licensed under ...") gives none either.
    Null or empty texts have no paragraphs. Repeated rows repeat their results, null ids are carried, an empty table gives an empty result.
    """
    markers = vocabulary(templates)[1]
    # Exact: without one of these words there is no feature, and the answer is ``unknown``.
    wanted = staged(paragraphs(df, id_col, text_col, markers))
    model = Classifier(wanted.where("alone").select("ws"), templates)
    spoken = {f: sorted({r for g, text in templates if g == f for r in vocabulary(((g, text),))[0]}) for f in model.families[1:]}
    own = df.sparkSession.createDataFrame([(i, model.own[f], spoken[f]) for i, f in enumerate(model.families) if i], "family int, own array<string>, spoken array<string>")
    units = vectors(wanted, model.runs).where(F.size("runs") > 0)
    first = met = staged(named_families(model, units))
    sure = first.where(F.col("similarity") >= CONTAINED)
    # What a line says besides the confirmed family: each round takes one away, so there are as many as a line names licences.
    last = sure
    while not last.isEmpty():
        left = last.join(F.broadcast(own), "family").select("doc_id", *UNIT, "ws", F.array_except("runs", "own").alias("runs"))
        last = staged(named_families(model, counted(left, model.runs).where(F.size("runs") > 0))).where(F.col("similarity") >= CONTAINED)
        sure = stacked(sure, last)
    sure, key = staged(sure.join(F.broadcast(own), "family").withColumn("n", F.size(F.array_intersect(features(F.col("ws")), "spoken")))), ["uid", "block"]
    # Families and how much of their templates is held: a few for each block.
    every = sure.groupBy(*key).agg(F.collect_list(F.struct("family", "alone", "n")).alias("every"))
    same = lambda alone: F.filter("every", lambda x: (x["family"] == F.col("family")) & (x["alone"] == alone))
    # One line that confirms a family of which its block holds more is a part of a wrapped notice.
    wrapped = (F.size(same(True)) == 1) & F.exists(same(False), lambda x: x["n"] > F.get(same(True), F.lit(0))["n"])
    kept = sure.join(every, key).where(F.when(F.col("alone"), ~wrapped).otherwise(wrapped | (F.size(same(True)) == 0)))
    # A block begins where the first triple of the family's templates does.
    begins = F.array_min(F.transform(word_runs(F.col("ws"), 3), lambda x, i: F.when(F.array_contains("spoken", x), F.get("at", i))))
    kept = kept.withColumn("paragraph", F.coalesce(begins, F.col("at")[0])).withColumn("confirmed", F.lit(True))
    # Believed only: lines that confirm nothing and are no part of a confirmed block of the family.
    weak = met.where(F.col("alone") & (F.col("similarity") < CONTAINED)).withColumn("paragraph", F.col("at")[0]).withColumn("confirmed", F.lit(False))
    weak = weak.join(sure.where("alone").select(*key, F.col("at")[0].alias("paragraph")).distinct(), [*key, "paragraph"], "left_anti")
    weak = weak.join(sure.where(~F.col("alone")).select(*key, "family").distinct(), [*key, "family"], "left_anti")
    names = ["doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", "similarity", "confirmed"]
    out = stacked(kept.select(*names), weak.select(*names))
    return out.withColumn("family", F.element_at(F.array(*map(F.lit, model.families)), F.col("family") + 1))
