"""Licence scan: a trained paragraph classifier whose predictions templates confirm.

A paragraph is a line or a run of neighbouring lines without a blank one (one
without words, so comment marks alone are blank, and others are no words) whose
inner lines have at most ``RUN`` times the words of the longest template. Of
overlapping runs of a family the best counts (the share of the template, more
for longer templates, less ``LINE_COST`` per further line), of other families
only confirmed ones beside it. Its features are the word 1- and 2-grams it shares with
the licence templates, so the feature space is fixed by the templates. A
sparse (L1) multinomial logistic regression tells the licence families and
``unknown`` apart. It is fitted on copies of the templates with words left
out, half of them inside other text, and on at most ``SAMPLE`` paragraphs of
the corpus (the first by hash), which are ``unknown`` unless a template covers
them. A quarter of these rows is held back to set the temperature that makes
the probabilities of families and of ``unknown`` fit. A predicted family is
then confirmed by the share of a template's grams that the paragraph has.

All paragraphs are scored. A family needs odds over ``unknown`` above zero, so a
paragraph whose grams' largest weights do not make up for the largest bias is
``unknown`` at once; only the others are scored family by family.
Only DataFrame operations and Spark ML are used; weights and templates are
small fixed tables, and a document's paragraphs never meet in a shuffle.

Null or empty texts have no licence paragraph. Repeated rows give repeated
results. A tie between families goes to the first by name. Other columns of
the input are unread. Without documents the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

# Usual short notices of each family.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd-3-clause", "Distributed under the 3-clause BSD License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    ("public-domain", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
)
UNKNOWN = "unknown"
# most corpus paragraphs the classifier is fitted on
SAMPLE = 4000
RUN = 1.5
# what a further line must add to a run's score; one word of any template adds more
LINE_COST = 0.05
# of a paragraph that is only fitted on, so many characters are taken
SAMPLE_CHARACTERS = 500
VARIANTS = 40
DROPPED_PERCENT = 12
REGULARISATION = 0.002
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
LEAST_PROBABILITY = 0.5
CONFIRMED = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def grams_of(words: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_union(words, F.filter(pairs, lambda p: p.isNotNull()))


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(i, family, text) for i, (family, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, family string, text string").select(
        "template_id", "family", words_of(F.col("text")).alias("words")
    ).withColumn("grams", grams_of(F.col("words")))


@dataclass
class Classifier:
    """Weights per gram over those of ``unknown``, biases likewise, and the temperature."""

    families: list[str]
    weights: DataFrame  # (gram, weight: array<double>, one per family)
    lifting: list[tuple[str, float]]  # grams that raise some family, and by how much at most
    bias: list[float]
    temperature: float


def _covers(words: Column, template: Column) -> Column:
    return F.size(F.array_intersect(template, words)) / F.size(template)


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(family, words): template copies with words left out, and a bounded sample of paragraphs."""
    spark = docs.sparkSession
    templates = cut_lineage(template_table(spark))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    drawn = cut_lineage(
        lines.select(F.substring("line", 1, SAMPLE_CHARACTERS).alias("line"), F.xxhash64("doc_id", "paragraph", "line").alias("h"))
        .orderBy("h").limit(sample).select(words_of(F.col("line")).alias("words"), "h")
    )
    # at most ``sample`` rows times the templates
    best = drawn.join(F.broadcast(templates.select("family", F.col("grams").alias("t"))), F.arrays_overlap("words", "t"), "left").groupBy("h").agg(
        F.max(F.struct(F.coalesce(_covers(grams_of(F.col("words")), F.col("t")), F.lit(0.0)).alias("share"), "family")).alias("best"),
        F.first("words").alias("words"),
    )
    seen = best.select(F.when(F.col("best.share") >= 0.8, F.col("best.family")).otherwise(UNKNOWN).alias("family"), "words", "h")
    copies = templates.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(VARIANTS)]))).withColumn(
        "h", F.xxhash64("template_id", "copy")
    )
    left = F.filter("words", lambda w, i: F.pmod(F.xxhash64(F.col("h"), i), F.lit(100)) >= DROPPED_PERCENT)
    copies = copies.select("family", F.when(F.col("copy") == 0, F.col("words")).otherwise(left).alias("words"), "h", "copy")
    around = drawn.select(F.pmod("h", F.lit(997)).alias("slot"), F.slice("words", 1, 60).alias("noise")).groupBy("slot").agg(F.first("noise").alias("noise"))
    copies = copies.withColumn("slot", F.when(F.col("copy") % 2 == 1, F.pmod("h", F.lit(997)))).join(around, "slot", "left").select(
        "family", F.concat(F.coalesce("noise", F.array().cast("array<string>")), "words").alias("words"), "h"
    )
    return seen.unionByName(copies).where(F.size("words") > 0)


def _margins(rows: DataFrame, model: Classifier, key: list[str]) -> DataFrame:
    """Odds of each family against ``unknown`` as an array; rows without a known gram get the biases."""
    grams = rows.select(*key, F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram")
    sums = [F.sum(F.col("weight")[i]) + F.lit(model.bias[i]) for i in range(len(model.families))]
    return grams.groupBy(*key).agg(F.array(*sums).alias("odds"))


def _probabilities(odds: Column, temperature: float) -> Column:
    """Probabilities of the families; what is missing to one is that of ``unknown``."""
    powers = F.transform(odds, lambda o: F.exp(F.least(o / temperature, F.lit(500.0))))
    total = F.aggregate(powers, F.lit(1.0), lambda a, b: a + b)
    return F.transform(powers, lambda p: p / total)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    spark = docs.sparkSession
    rows = cut_lineage(training_rows(docs, sample).withColumn("grams", grams_of(F.col("words"))).coalesce(1))
    vocabulary = sorted({g for r in template_table(spark).select("grams").collect() for g in r["grams"]})
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    names = sorted({family for family, _ in TEMPLATES})
    label = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("family")), F.lit(0)), F.lit(0)).cast("double")
    marked = vectors.transform(rows).withColumn("label", label).withColumn("held", F.pmod(F.xxhash64("h", F.lit("held")), F.lit(4)) == 0)
    learner = LogisticRegression(
        family="multinomial", regParam=REGULARISATION, elasticNetParam=1.0, standardization=False, maxIter=60
    )
    found = learner.fit(marked.where("not held").select("label", "features"))
    matrix, bias = found.coefficientMatrix.toArray(), found.interceptVector.toArray()
    names = names[: matrix.shape[0] - 1]
    over = matrix[1:] - matrix[0]
    used = [i for i in range(len(vocabulary)) if over[:, i].any()]
    weights = spark.createDataFrame(
        [(vocabulary[i], [float(x) for x in over[:, i]]) for i in used] or [("", [0.0] * len(names))],
        "gram string, weight array<double>",
    )
    model = Classifier(
        names, weights, [(vocabulary[i], float(over[:, i].max())) for i in used if (over[:, i] > 0).any()], [float(b - bias[0]) for b in bias[1:]], 1.0
    )
    held = marked.where("held").select("h", "label", "grams")
    odds = held.select("h", "label").join(_margins(held, model, ["h"]), "h", "left").withColumn(
        "odds", F.coalesce("odds", F.array(*[F.lit(b) for b in model.bias]))
    )
    losses = []
    for t in TEMPERATURES:
        chance = _probabilities(F.col("odds"), t)
        own = F.when(F.col("label") > 0, F.get(chance, F.col("label").cast("int") - 1)).otherwise(
            1 - F.aggregate(chance, F.lit(0.0), lambda a, b: a + b)
        )
        losses.append(F.avg(-F.log(F.greatest(own, F.lit(1e-12)))).alias(f"t{len(losses)}"))
    loss = odds.agg(*losses).first()
    if loss[0] is not None:
        model.temperature = min(zip(loss, TEMPERATURES))[1]
    return model


def _most(words: Column, model: Classifier) -> Column:
    """No family's odds over ``unknown`` are above this: a pair of words counts if its first word is there."""
    lift: dict[str, float] = {}
    for gram, weight in model.lifting:
        first = gram.split(" ")[0]
        lift[first] = lift.get(first, 0.0) + weight
    names = F.array(*[F.lit(w) for w in lift]) if lift else F.array().cast("array<string>")
    lifts = F.array(F.lit(0.0), *[F.lit(x) for x in lift.values()])
    return F.aggregate(
        F.array_intersect(words, names), F.lit(max(model.bias, default=-1.0)),
        lambda s, w: s + F.get(lifts, F.array_position(names, w).cast("int")),
    )


def _runs(docs: DataFrame, model: Classifier) -> DataFrame:
    """(row, doc_id, paragraph, lines, words) of the runs of lines that lie at words which raise some family."""
    spark = docs.sparkSession
    most = int(RUN * template_table(spark).agg(F.max(F.size("words"))).first()[0])
    raising = sorted({gram.split(" ")[0] for gram, _ in model.lifting})
    names = F.array(*[F.lit(w) for w in raising]) if raising else F.array().cast("array<string>")
    every = F.lit(max(model.bias, default=-1.0) >= 0)
    lined = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", F.transform(F.split("text", "\n"), words_of).alias("all")
    )
    lined = lined.select(
        "row", "doc_id", "all", F.transform("all", lambda w: F.size(w)).alias("sizes"),
        F.transform("all", lambda w: F.arrays_overlap(w, names) | every).alias("near"),
    ).where(F.exists("near", lambda x: x))

    def at(i):
        return F.coalesce(F.get("near", i), F.lit(False))

    def use(i):
        return (F.get("sizes", i) > 0) & (at(i - 1) | at(i) | at(i + 1))

    def inner(i, j):
        between = F.slice("sizes", i + 2, F.greatest(j - i - 1, F.lit(0)))
        return F.aggregate(between, F.lit(0), lambda n, x: n + F.when(x == 0, most + 1).otherwise(x))

    def ends(i):
        last = F.least(i + most + 1, F.size("all") - 1)
        return F.filter(F.sequence(i, last), lambda j: use(j) & (inner(i, j) <= most))

    def run(i, j):
        return F.struct(i.alias("paragraph"), (j - i + 1).alias("lines"), F.flatten(F.slice("all", i + 1, j - i + 1)).alias("words"))

    starts = F.filter(F.sequence(F.lit(0), F.size("all") - 1), use)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(ends(i), lambda j: run(i, j))))
    return lined.select("row", "doc_id", F.explode(runs).alias("run")).select("row", "doc_id", "run.*")


def _best_runs(found: DataFrame) -> DataFrame:
    """Of the runs that share a line the best of each family, and of the families the best and all confirmed."""
    rank = F.struct("score", -F.col("lines"), -F.col("paragraph"))
    lines = found.withColumn("rank", rank).withColumn("line", F.explode(F.expr("sequence(paragraph, paragraph + lines - 1)")))
    own, others = Window.partitionBy("row", "line", "family"), Window.partitionBy("row", "line")
    kept = (F.col("rank") == F.max("rank").over(own)) & (F.col("confirmed") | (F.col("rank") == F.max("rank").over(others)))
    key = ["row", "paragraph", "lines"]
    return found.join(lines.select(*key, kept.alias("kept")).groupBy(*key).agg(F.min("kept").alias("kept")).where("kept"), key).drop("kept")


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, paragraph, lines, family, probability, template_id, similarity, confirmed) of each licence paragraph.

    ``paragraph`` is its first line, counted from zero, and ``lines`` their number.
    """
    key = ["row", "paragraph", "lines"]
    likely = _runs(docs, model).where(_most(F.col("words"), model) >= 0)
    lines = cut_lineage(likely.select(*key, "doc_id", grams_of(F.col("words")).alias("grams")))
    odds = lines.join(_margins(lines, model, key), key)
    chance = _probabilities(F.col("odds"), model.temperature)
    best = F.array_max(F.transform(chance, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    families = F.array(*[F.lit(n) for n in model.families])
    named = odds.withColumn("best", best).where(F.col("best.p") >= LEAST_PROBABILITY).select(
        *key, "doc_id", "grams", F.get(families, -F.col("best.i")).alias("family"), F.col("best.p").alias("probability")
    )
    templates = template_table(docs.sparkSession).select("template_id", "family", F.col("grams").alias("__t"))
    share = _covers(F.col("grams"), F.col("__t"))
    found = (
        named.join(F.broadcast(templates), "family")  # the fixed templates
        .groupBy(*key)
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("family").alias("family"), F.first("probability").alias("probability"),
            F.max(F.struct(share.alias("share"), F.size("__t").alias("size"), (-F.col("template_id")).alias("t"))).alias("best"),
        )
        .select(
            *key, "doc_id", "family", "probability", (-F.col("best.t")).alias("template_id"),
            F.col("best.share").alias("similarity"), (F.col("best.share") >= CONFIRMED).alias("confirmed"),
            (F.col("best.share") * F.log2(F.col("best.size") + 1) - LINE_COST * (F.col("lines") - 1)).alias("score"),
        )
    )
    return _best_runs(cut_lineage(found)).select(
        "doc_id", "paragraph", "lines", "family", "probability", "template_id", "similarity", "confirmed"
    )
