"""Licence scans: a trained classifier of paragraphs, confirmed against templates.

A paragraph (a line, cut after sentence ends) becomes the set of its word pairs and triples. A sparse multinomial
logistic regression over the n-grams of licence notices gives each family a probability, with a temperature and a
floor for the unknown class set on rows held out of the training. Two things are classified: a paragraph most of whose
n-grams are found in notices of one family, and, where most n-grams of one notice stand in a paragraph, the run of
that notice's length that holds most of them. So a notice counts whatever else its line or sentence says, and a
paragraph may hold several licences.

The model is small and fixed in size (at most ``VOCABULARY`` n-grams), so it travels with the expression: scanning is
row-local, reads only the text, and shuffles nothing.

Edge cases: null and empty texts have no licence; a text of any length is scanned whole; repeated rows get equal
results; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from statistics import median

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.llm.common import stage

#: Notices by family; the sentences of each are the templates. Fixed values.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under the Creative Commons Attribution License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0 for non-commercial use only.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0": [
        "Licensed under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU General Public License version 2 or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL v3.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright the authors, all rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Sentences that share words with notices and license nothing. Fixed values.
OTHERS = [
    "The version of the story that was released under pressure is not the one you may know.",
    "He was licensed to drive a bus in the city and to carry any person free of charge.",
    "A copy of the general plan is available under the desk of the public office.",
    "The work is a part of the public library and of the terms we agreed to in writing.",
    "You can use this file to see the conditions of the software in the following list.",
    "All children have rights and the foundation has reserved a table for the authors.",
    "Permission was granted by the agency to any of the companies to deal in oil.",
    "The publisher said that the source of the form is subject to change without notice.",
    "Copyright is a form of law that covers creative work in the commons of culture.",
    "She should have received the letter along with this program of the concert.",
    "The software is distributed in two versions, and the license costs ten dollars.",
    "An international court of general law is in the public domain of debate.",
]
VOCABULARY = 4096
BUCKETS = 1 << 16
UNKNOWN = "unknown"
SPLIT = r"[\n\r]+|(?<=[.!?;])[ \t]+"
TOKEN = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"


def constant(values: list, kind: str) -> Column:
    """A list as one constant that the optimizer folds once (JSON parsing would run per use)."""
    return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), SPLIT)


def tokens(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(TOKEN), F.lit(0))


def ngrams(paragraph: Column) -> Column:
    """The distinct word pairs and triples of a paragraph, in lower case."""
    return once(tokens(paragraph), ngrams_of)


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def ngrams_of(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    triples = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    none = F.array().cast("array<string>")
    return F.when(F.size(words) > 2, F.array_distinct(F.concat(pairs, triples))).when(F.size(words) == 2, pairs).otherwise(none)


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def training_rows(spark: SparkSession, variants: int) -> DataFrame:
    """(family, grams, held_out): every notice as it is and in variants that lack words, chosen by a hash."""
    rows = [(f, s, i) for f, notices in [*NOTICES.items(), (UNKNOWN, OTHERS)] for s in notices for i in range(variants)]
    entries = constant(["\t".join(map(str, r)) for r in rows], "string")
    fields = spark.range(1).select(F.explode(entries).alias("r")).select(F.split("r", "\t").alias("r"))
    texts = fields.select(F.col("r")[0].alias("family"), F.col("r")[1].alias("text"), F.col("r")[2].cast("int").alias("variant"))
    words = F.split("text", " ")
    kept = F.filter(words, lambda w, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64(w, i, F.col("variant")), F.lit(12)) > 0))
    held = (F.col("variant") > 0) & (F.pmod(F.xxhash64("text", "variant"), F.lit(5)) == 0)
    return texts.select("family", ngrams(F.array_join(kept, " ")).alias("grams"), held.alias("held_out"))


def sentence_rows(spark: SparkSession) -> DataFrame:
    """(family, n_words, grams) of every sentence of the notices that has two words."""
    entries = constant([f"{f}\t{s}" for f, notices in NOTICES.items() for s in notices], "string")
    fields = spark.range(1).select(F.explode(entries).alias("r")).select(F.split("r", "\t").alias("r"))
    cut = fields.select(F.col("r")[0].alias("family"), F.explode(paragraphs(F.col("r")[1])).alias("text")).distinct()
    rows = cut.select("family", F.size(tokens(F.col("text"))).alias("n_words"), ngrams(F.col("text")).alias("grams"))
    return rows.filter("n_words > 1")


class LicenseModel:
    """Weights and thresholds as plain lists; ``scan`` turns them into expressions. ``templates``: the n-grams of each
    family; ``sentences``: family, words and n-grams of each sentence; ``slots``: the bucket of each of these n-grams."""

    def __init__(self, families, grams, buckets, weights, intercepts, temperature, floor, templates, sentences, slots):
        self.sentences, self.slots = sentences, slots
        self.families, self.grams, self.buckets, self.weights = families, grams, buckets, weights
        self.intercepts, self.temperature, self.floor, self.templates = intercepts, temperature, floor, templates


def fit(spark: SparkSession, variants: int = 24, strength: float = 0.002) -> LicenseModel:
    """Train on the notices; temperature and floor come from the variants that are held out."""
    rows = stage(training_rows(spark, variants).coalesce(1), "license-notices")
    # bounded by the notices: at most VOCABULARY n-grams, those of most rows first
    counts = rows.filter("not held_out").select(F.explode("grams").alias("gram")).groupBy("gram").count()
    grams = [r["gram"] for r in counts.orderBy(F.desc("count"), "gram").limit(VOCABULARY).collect()]
    families = sorted([*NOTICES, UNKNOWN])
    code = F.array_position(constant(families, "string"), F.col("family")) - 1
    known = constant(grams, "string")
    vector = array_to_vector(F.transform(known, lambda g: F.array_contains("grams", g).cast("double")))
    ready = rows.select(code.cast("double").alias("label"), vector.alias("features"), "held_out")
    ready = ready.repartition(1).cache()  # some hundred rows
    ready.count()
    learner = LogisticRegression(family="multinomial", regParam=strength, elasticNetParam=0.7, maxIter=30)
    fitted = learner.fit(ready.filter("not held_out"))
    scored = [(int(r["label"]), list(r["rawPrediction"])) for r in fitted.transform(ready.filter("held_out")).collect()]
    ready.unpersist()
    temperature, floor = calibrate(scored, families.index(UNKNOWN))
    matrix = fitted.coefficientMatrix.toArray()
    used = [j for j in range(len(grams)) if abs(matrix[:, j]).max() > 1e-4]
    table = constant([grams[j] for j in used], "string")
    at = spark.range(1).select(F.transform(table, bucket).alias("b")).first()["b"]
    templates = {
        r["family"]: r["grams"]
        for r in rows.filter(F.col("family") != UNKNOWN).groupBy("family")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("grams")).collect()
    }
    sentences = [(r["family"], r["n_words"], r["grams"]) for r in sentence_rows(spark).collect()]
    known = sorted({g for found in [*templates.values(), *(s[2] for s in sentences)] for g in found})
    places = spark.range(1).select(F.transform(constant(known, "string"), bucket).alias("b")).first()["b"]
    return LicenseModel(families, [grams[j] for j in used], at, [[float(v) for v in matrix[:, j]] for j in used],
                        [float(v) for v in fitted.interceptVector], temperature, floor, templates, sentences,
                        dict(zip(known, places, strict=True)))


def calibrate(scored: list[tuple[int, list[float]]], unknown: int) -> tuple[float, float]:
    """The temperature of least log loss, and the floor: halfway between the largest family probability of a held-out
    row without licence and the median one of rows with a licence."""

    def softmax(raw: list[float], t: float) -> list[float]:
        top = max(raw)
        e = [math.exp((x - top) / t) for x in raw]
        return [x / sum(e) for x in e]

    if not scored:
        return 1.0, 0.5

    def loss(t: float) -> float:
        return -sum(math.log(max(softmax(raw, t)[label], 1e-12)) for label, raw in scored)

    temperature = min((0.25 * 1.25**i for i in range(16)), key=loss)
    best = [(label, max(p for i, p in enumerate(softmax(raw, temperature)) if i != unknown)) for label, raw in scored]
    without = [p for label, p in best if label == unknown] or [0.0]
    licensed = [p for label, p in best if label != unknown] or [1.0]
    return temperature, min(0.9, (max(without) + median(licensed)) / 2)


def scan(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text",
         confirm: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: id, licenses (families in order, joined by commas; null if none), n_paragraphs
    (those with a confirmed licence), score (the largest probability, else 0) and ``found``, one (paragraph number,
    family, probability, share) for each licence of a paragraph. The share is that of the sentence's n-grams found in
    the run, or that of the paragraph's n-grams found in the family's notices."""
    classes, unknown = len(model.families), model.families.index(UNKNOWN)
    slots = [0] * BUCKETS
    merged: dict[int, list[float]] = {}
    for b, w in zip(model.buckets, model.weights, strict=True):
        merged[b] = [x + y for x, y in zip(merged.get(b, [0.0] * classes), w, strict=True)]
    for i, b in enumerate(sorted(merged)):
        slots[b] = i + 1
    slot_of = constant(slots, "int")
    flat = constant([x for b in sorted(merged) for x in merged[b]], "double")
    start = constant(model.intercepts, "double")
    names = constant(model.families, "string")
    templates = F.array(*[constant(model.templates.get(f, []), "string") for f in model.families])
    # a first look by buckets, which lets through all that the n-grams themselves would
    marks = [0] * BUCKETS
    for i, b in enumerate(sorted(set(model.slots.values()))):
        marks[b] = i + 1
    mark_of = constant(marks, "int")
    marked = [sorted({marks[model.slots[g]] for g in grams}) for _, _, grams in model.sentences]
    needed = [max(1, math.ceil(confirm * len(s[2]) - 1e-9) - len(s[2]) + len(m)) for s, m in zip(model.sentences, marked, strict=True)]
    sentence_marks = F.array(*[constant(m, "int") for m in marked])
    sentence_grams = F.array(*[constant(grams, "string") for _, _, grams in model.sentences])
    sentence_words = constant([n for _, n, _ in model.sentences], "int")
    sentence_family = constant([model.families.index(f) for f, _, _ in model.sentences], "int")
    need, numbers = constant(needed, "int"), constant(list(range(len(model.sentences))), "int")

    def weights(slot: Column) -> Column:
        return F.slice(flat, (slot - 1) * classes + 1, F.lit(classes))

    def looked_up(unit: Column) -> Column:
        hits = F.filter(F.transform(unit["grams"], lambda g: F.get(mark_of, bucket(g))), lambda s: s > 0)
        return F.struct(unit["at"].alias("at"), unit["text"].alias("text"), unit["grams"].alias("grams"), hits.alias("hits"))

    def compared(unit: Column) -> Column:
        near = F.filter(numbers, lambda t: F.size(F.array_intersect(F.get(sentence_marks, t), unit["hits"])) >= F.get(need, t))
        whole = F.size(unit["hits"]) >= F.size(unit["grams"]) * confirm
        return F.struct(unit["at"].alias("at"), unit["text"].alias("text"), unit["grams"].alias("grams"),
                        whole.alias("whole"), near.alias("near"))

    def best_run(words: Column, sentence: Column) -> Column:
        """The n-grams of the first run that shares most with the sentence, of the same number of words."""
        length = F.get(sentence_words, sentence)

        def of(begin: Column) -> Column:
            return once(F.slice(words, begin + 1, length), ngrams_of)

        begins = F.sequence(F.lit(0), F.greatest(F.size(words) - length, F.lit(0)))
        shared = F.transform(begins, lambda i: F.struct(F.size(F.array_intersect(F.get(sentence_grams, sentence), of(i))).alias("n"), (-i).alias("i")))
        return once(F.array_max(shared), lambda best: of(-best["i"]))

    def candidates(unit: Column) -> Column:
        def candidate(grams: Column, sentence: Column) -> Column:
            return F.struct(unit["at"].alias("at"), grams.alias("grams"), sentence.cast("int").alias("sentence"))

        whole = F.filter(F.array(candidate(unit["grams"], F.lit(-1))), lambda _: unit["whole"])
        return once(tokens(unit["text"]), lambda words: F.concat(whole, F.transform(unit["near"], lambda t: candidate(best_run(words, t), t))))

    def judged(unit: Column) -> Column:
        hits = F.filter(F.transform(unit["grams"], lambda g: F.get(slot_of, bucket(g))), lambda s: s > 0)
        raw = F.aggregate(hits, start, lambda acc, s: F.zip_with(acc, weights(s), lambda a, b: a + b))
        return F.struct(unit["at"].alias("at"), unit["grams"].alias("grams"), unit["sentence"].alias("sentence"),
                        F.size(hits).alias("hits"), raw.alias("raw"))

    def decided(unit: Column) -> Column:
        top = F.array_max(unit["raw"])
        powers = F.transform(unit["raw"], lambda x: F.exp((x - top) / model.temperature))
        family = F.array_position(unit["raw"], top).cast("int") - 1
        probability = F.array_max(powers) / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
        return F.struct(unit["at"].alias("at"), unit["grams"].alias("grams"), unit["sentence"].alias("sentence"),
                        family.alias("family"), probability.alias("probability"))

    def confirmed(unit: Column) -> Column:
        sentence = F.get(sentence_grams, unit["sentence"])
        whole = F.size(F.array_intersect(unit["grams"], F.get(templates, unit["family"]))) / F.size(unit["grams"])
        run = F.size(F.array_intersect(unit["grams"], sentence)) / F.size(sentence)
        share = F.when(unit["sentence"] < 0, whole).when(F.get(sentence_family, unit["sentence"]) == unit["family"], run)
        return F.struct(unit["at"].alias("paragraph"), F.get(names, unit["family"]).alias("family"),
                        unit["probability"].alias("probability"), F.coalesce(share, F.lit(0.0)).alias("share"))

    units = F.transform(
        paragraphs(F.col(text_col)), lambda p, i: F.struct(i.alias("at"), p.alias("text"), ngrams(p).alias("grams"))
    )
    with_hits = F.filter(F.transform(units, looked_up), lambda u: F.size(u["hits"]) > 0)
    near = F.filter(F.transform(with_hits, compared), lambda u: u["whole"] | (F.size(u["near"]) > 0))
    scored = F.filter(F.transform(F.flatten(F.transform(near, candidates)), judged), lambda u: u["hits"] > 0)
    likely = F.filter(F.transform(scored, decided), lambda u: (u["family"] != unknown) & (u["probability"] >= model.floor))
    every = F.filter(F.transform(likely, confirmed), lambda u: u["share"] >= confirm)
    # several sentences of a family may be found in a paragraph; the one of most probability stays
    kept = once(F.reverse(F.array_sort(every)), lambda rows: F.filter(rows, lambda u, i: (i == 0) | ~F.coalesce(
        (F.get(rows, i - 1)["paragraph"] == u["paragraph"]) & (F.get(rows, i - 1)["family"] == u["family"]), F.lit(False))))
    found = F.reverse(kept)
    scanned = docs.select(F.col(id_col), found.alias("found"))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda u: u["family"])))
    return scanned.select(
        id_col,
        F.when(F.size("found") > 0, F.array_join(families, ",")).alias("licenses"),
        F.size(F.array_distinct(F.transform("found", lambda u: u["paragraph"]))).alias("n_paragraphs"),
        F.coalesce(F.array_max(F.transform("found", lambda u: u["probability"])), F.lit(0.0)).alias("score"),
        "found",
    )
