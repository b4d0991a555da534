"""Licence scans: a trained paragraph classifier over word n-grams, with an unknown class and template comparison.

A paragraph ends at a blank line, or where a line that ends a sentence does; a sentence wrapped over lines is one
paragraph. Features are single words and pairs of neighbours of a paragraph (`ALNUM_WORD`, A-Z lower-cased) that hold at
least one licence word: a word of the templates that is not on a fixed list of everyday words (`EVERYDAY`), whatever the
corpus holds. A feature of the templates' variants is a column of its own; the others, whose number grows with the corpus,
share `HASHED` columns. A multinomial logistic regression (an ML estimator of Spark's) is fitted to variants of each
family's templates, each with some of its words left out, and, as the class `unknown`, to the background: every different
paragraph of the corpus that holds a licence word and doesn't resemble a template (half or more of the licence words of
one, two at least), and the paragraph without a feature. The least probability that names a family is calibrated on all of
them, each scored by a model fitted to the half that it isn't in. What is named is compared with the family's templates:
it is confirmed if it holds half or more of the words of one of them, or a template holds most of its words. "All rights
reserved." alone reserves all rights, so it is `proprietary`.

A paragraph without a licence word has no feature, so its class is that of the intercepts, `unknown`; this is tested
first, and only the others are split up and scored. All such paragraphs are one row to the model, so they are neither
drawn nor counted; the row's weight is fixed. Null and empty texts have no paragraph; a very long text is one array of its
paragraphs. Repeated rows and repeated paragraphs teach the model once, and are counted as they stand in what is found;
rows of a repeated doc_id have the findings of all; ties between families go to the first by name. An empty table gives no
rows. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower, words_of, written

#: What the background weighs in all, at most (a variant of a template weighs 1): none of it is left out, but each of many weighs less.
BACKGROUND = 3_000
#: What the paragraph without a feature weighs, so that the class `unknown` is there in a corpus of notices alone.
FEATURELESS = 3_000
#: Columns that the features share by hash which the templates don't have.
HASHED = 4_096
#: Rows in a part of the table that the classifier is fitted to, about; every part sends its gradient in every step.
PART_ROWS = 10_000
#: Words of templates that say nothing of a licence. `mit` is one for itself (German), but counts in what resembles a template.
EVERYDAY = frozenset("""all an and any are as at be by can charge code conditions deal either except file files following for form forms found
free general governed http in international into is it later library may met mit no not of or org part person program prior
provided public publication published publisher sa software source style subject terms that the this to under use version
with without work written www you""".split())
#: The notices by which the families are known.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "Licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "This work is licensed under the GNU General Public License, version 3."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Licensed under the MIT license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Copyright. All rights reserved."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
}


def _grams(words: Column, vocabulary: Column) -> Column:
    pairs = F.expr("if(size(w) < 2, cast(array() AS array<string>), transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])))")
    return F.array_distinct(F.filter(F.concat(words, pairs), lambda g: F.arrays_overlap(F.split(g, " "), vocabulary)))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, branching letter by letter, so that a position is given up at its first wrong letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + (_any_of(rest) if any(rest) else "") for h, rest in sorted(heads.items()) if h]
    return f"(?:{'|'.join(parts)}){'?' if '' in heads else ''}"


#: Where paragraphs end; the break itself is left out.
BREAK = r"(?<=[.!?:;])[ \t\r]*\n|\n[ \t\r]*\n"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace(chr(92), chr(92) * 2) + "'"


def _words(text: Column) -> Column:
    return words_of(ascii_lower(text), ALNUM_WORD)


def _variants(templates: DataFrame) -> DataFrame:
    """(family, variant, w): each template whole, and without every word whose hash falls in one of some tenths."""
    some = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return some.select("family", "variant", F.expr("filter(w, (x, i) -> variant = 0 OR pmod(xxhash64(variant, i), 100) >= 4 * variant)").alias("w")).where("size(w) > 0")


class Scanner:
    """A fitted model, the licence words, the least probability of a family, and the templates' words."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
        templates = spark.createDataFrame(rows, "family string, text string").select("family", _words(F.col("text")).alias("w"))
        held = [(r["family"], set(r["w"])) for r in templates.collect()]
        self.vocabulary = sorted({x for _, w in held for x in w if len(x) > 1} - EVERYDAY)
        self.templates = [(f, sorted(w)) for f, w in held]
        self.families = sorted([*TEMPLATES, "unknown"])
        self._own = self._split(docs)
        # A paragraph of the background is told by a hash of its text, which also says in which half it is.
        background = written(self._own.where(~self._resembles()).select(F.xxhash64("line").alias("h"), "grams").distinct())
        n = background.count()
        unknown = F.lit("unknown").alias("family")
        other = background.select(unknown, F.pmod("h", F.lit(2)).cast("int").alias("half"), F.lit(min(1.0, BACKGROUND / max(1, n))).alias("weight"), "grams")
        none = spark.range(2).select(unknown, F.col("id").cast("int").alias("half"), F.lit(FEATURELESS / 2).alias("weight"), F.expr("cast(array() AS array<string>)").alias("grams"))
        known = written(_variants(templates).select("family", (F.col("variant") % 2).alias("half"), F.lit(1.0).alias("weight"), _grams(F.col("w"), F.lit(self.vocabulary)).alias("grams")))
        every = written(known.union(other).union(none).repartition(1 + n // PART_ROWS))
        self._features = self._columns(known)
        halves = [self._classed(every.where(F.col("half") == k), self._fitted(every.where(F.col("half") != k))) for k in (0, 1)]
        best = halves[0].union(halves[1]).agg(F.max(F.when(F.col("family") == "unknown", F.when(F.col("named") != "unknown", F.col("p")))).alias("wrong"), F.percentile_approx(F.when((F.col("family") != "unknown") & (F.col("named") == F.col("family")), F.col("p")), 0.02).alias("right")).first()
        # Above what the background reaches, but not above nearly all that is right.
        self.least = min(max(best["wrong"] or 0.0, 0.3), max(best["right"] or 0.5, 0.3))
        self.model = self._fitted(every)

    def _columns(self, known: DataFrame) -> PipelineModel:
        """From `grams` and `rest` to `features`: a column for each feature of `known`, and those that the rest shares."""
        counts = CountVectorizer(inputCol="grams", outputCol="_own", binary=True, minDF=1).fit(known)
        self._named = counts.vocabulary
        return PipelineModel([counts, HashingTF(inputCol="rest", outputCol="_rest", binary=True, numFeatures=HASHED), VectorAssembler(inputCols=["_own", "_rest"], outputCol="features")])

    def _vectors(self, paragraphs: DataFrame) -> DataFrame:
        return self._features.transform(paragraphs.withColumn("rest", F.array_except("grams", F.lit(self._named)))).drop("rest", "_own", "_rest")

    def _fitted(self, rows: DataFrame) -> LogisticRegressionModel:
        label = (F.array_position(F.lit(self.families), F.col("family")) - 1).cast("double")
        return LogisticRegression(weightCol="weight", regParam=0.002, maxIter=60).fit(self._vectors(rows).withColumn("label", label))

    def _resembles(self) -> Column:
        """Whether the words `w` hold half or more of the licence words of a template, two at least."""
        marks = {tuple(x for x in t if x in self.vocabulary or x == "mit") for _, t in self.templates}
        shared = lambda m: F.size(F.array_intersect("w", F.array(*map(F.lit, m))))
        return F.greatest(*[shared(m) >= max(2, len(m) / 2) for m in sorted(marks)])

    def _classed(self, paragraphs: DataFrame, model: LogisticRegressionModel) -> DataFrame:
        """`paragraphs` with the likeliest class, `named`, and its probability, `p`."""
        scored = model.transform(self._vectors(paragraphs))
        p = vector_to_array("probability")
        return scored.withColumn("_p", p).withColumn("p", F.array_max("_p")).withColumn("named", F.element_at(F.lit(self.families), F.expr("cast(array_position(_p, array_max(_p)) AS int)")))

    def _split(self, docs: DataFrame) -> DataFrame:
        """(doc_id, at, line, w, grams): the paragraphs of `docs` that hold a licence word, `at` counted from 0."""
        # The words are ASCII; lower() folds more than that, so it finds all that the features can hold.
        has = lambda text: F.lower(text).rlike(f"(?<![a-z0-9]){_any_of(self.vocabulary)}(?![a-z0-9])")
        lines = docs.select("doc_id", F.when(has(F.col("text")), F.split("text", BREAK)).alias("lines"))
        # posexplode_outer: for posexplode(), Spark adds a filter that makes the array a second time.
        each = lines.select("doc_id", F.posexplode_outer("lines").alias("at", "line")).where(has(F.col("line")))
        # Few paragraphs are left. As a table: else Spark moves the filter on the class below all that makes it, and the
        # words of a paragraph are made anew for each of its pairs.
        split = written(each.select("doc_id", "at", "line", _words(F.col("line")).alias("w")))
        return split.withColumn("grams", _grams(F.col("w"), F.lit(self.vocabulary)))

    def paragraphs(self, docs: DataFrame | None = None) -> DataFrame:
        """(doc_id, at, line, named, p, likeness): the paragraphs that are named a family, of `docs` or else of those fitted to."""
        split = self._own if docs is None else self._split(docs)
        named = self._classed(split, self.model).where((F.col("named") != "unknown") & (F.col("p") >= self.least))
        own = lambda t: F.array(*map(F.lit, t))
        shared = lambda t: F.size(F.array_intersect("w", own(t)))
        like = F.coalesce(*[F.when(F.col("named") == f, F.greatest(*[F.greatest(shared(t) / len(t), F.when(shared(t) >= 4, shared(t) / F.size(F.array_distinct("w"))).otherwise(0.0)) for g, t in self.templates if g == f], F.lit(0.0))) for f in TEMPLATES])
        return named.select("doc_id", "at", "line", "named", "p", like.alias("likeness"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_paragraphs, families, confirmed (families of which a paragraph is confirmed), best."""
    found = Scanner(docs).paragraphs()
    per = found.groupBy(F.col("doc_id").alias("_d")).agg(F.count_distinct("at").alias("n_paragraphs"), F.array_sort(F.collect_set("named")).alias("families"), F.array_sort(F.collect_set(F.when(F.col("likeness") >= 0.5, F.col("named")))).alias("confirmed"), F.max("p").alias("best"))
    none = F.expr("cast(array() AS array<string>)")
    out = docs.select("doc_id").join(per, F.col("doc_id") == F.col("_d"), "left")
    return out.select("doc_id", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("families", none).alias("families"), F.coalesce("confirmed", none).alias("confirmed"), "best")


def op4(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_paragraphs", F.array_join("families", ",").alias("families"), F.array_join("confirmed", ",").alias("confirmed"), F.round("best", 6).alias("best"))
