"""Operator 10, licence scans by a trained paragraph classifier [native].

A paragraph is a line of a text, or neighbouring lines joined (none blank), as
notices are often wrapped; joined lines count where no line of theirs, nor a shorter
join, is a notice. The marks of comments are no words. A paragraph's words (lower-cased runs of letters and
digits) give unigram and bigram counts, hashed into a sparse vector. A multinomial
logistic regression over licence families and ``unknown`` scores paragraphs; it is
trained on the template notices below (whole, and with words left out) against a
bounded sample of other paragraphs of the corpus. A second, one-dimensional
logistic regression over held-out training rows turns the winning margin into a
calibrated probability of being right; below ``CONFIDENT`` the paragraph is
``unknown``. A prediction counts only if a template of that family confirms it: at
least ``COVERED`` of the template's bigrams occur in the paragraph.

A paragraph without certain bigrams of a template can't confirm it, so only
paragraphs with one of those are scored; that test loses none. All of it is
DataFrame operations and Spark's own JVM classifier.

Defined results: null and empty texts have no paragraphs and no licences; repeated
paragraphs of a text count each; rows that repeat a doc id share their result; an
empty table gives no rows (the classifier then trains on templates alone); other
columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import prepare, saved, table

#: Paragraphs of the corpus, beside the fixed ones, that stand for ``unknown``.
MAX_UNKNOWN = 2000
#: Different lines of the corpus among which these are found.
LINES = 8000
FEATURES = 1 << 14
CONFIDENT = 0.7
COVERED = 0.7

#: Usual short notices of each family.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "This software is confidential and proprietary; unauthorized copying or distribution is strictly prohibited.",
    ],
}
#: Sentences that use the words, but are no notice of a licence.
OTHERS = [
    "The driver showed a licence and the version of the form that the office had asked for.",
    "A license is a text that says what others may do with a work.",
    "The general public was asked to keep the copy under the table.",
    "He waived his rights and reserved a room for the software team.",
    "Apache helicopters and the public library are under the same roof.",
    "Use of the source was permitted with or without a guide.",
    "The foundation is free to publish the terms of the contract.",
    "Version 2.0 of the file was found in the work folder.",
    "All seats are reserved for the guests of the university.",
    "The commons of the town attribute their name to a person of note.",
]


def _spans(docs: DataFrame, id_col: str, text_col: str, longest: int, telling: list[str]) -> DataFrame:
    """(row, doc_id, line, n_lines, words) of the lines and of neighbouring ones
    joined, as far as they hold a ``telling`` word. A notice has at most ``longest``
    words: so have the lines between its first and its last, and no more of those two
    is joined. Only texts with such a word are split, and only lines from which one is in reach
    are joined."""
    some = F.lit(False)
    for w in telling:
        some = some | F.contains(F.col("folded"), F.lit(w))
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    named = named.withColumn("folded", F.lower("text")).where(some)
    with_words = F.transform(F.split("text", "\n"), lambda p, k: F.struct(k.alias("line"), _words(p).alias("words")))
    hot = F.lit(telling)
    lines = F.transform(F.col("lines"), lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"), F.arrays_overlap(x["words"], hot).alias("hot")))
    rows = named.select("row", "doc_id", with_words.alias("lines")).select("row", "doc_id", lines.alias("lines"))
    spans = F.expr(f"""flatten(transform(lines, (l, i) -> if(exists(slice(lines, i + 1, {longest + 2}), x -> x.hot),
        aggregate(slice(lines, i + 2, {longest + 1}),
            named_struct('open', size(l.words) > 0, 'hot', l.hot, 'inner', 0, 'words', slice(reverse(l.words), 1, {longest}),
                'out', if(l.hot, array(named_struct('line', l.line, 'n_lines', 1, 'words', l.words)), array())),
            (a, x) -> if(a.open and size(x.words) > 0 and a.inner <= {longest}, named_struct(
                'open', true, 'hot', a.hot or x.hot, 'inner', a.inner + size(x.words), 'words', concat(reverse(slice(x.words, 1, {longest})), a.words),
                'out', if(a.hot or x.hot, concat(a.out, array(named_struct('line', l.line, 'n_lines', x.line - l.line + 1,
                    'words', reverse(concat(reverse(slice(x.words, 1, {longest})), a.words))))), a.out)),
                named_struct('open', false, 'hot', a.hot, 'inner', a.inner, 'words', a.words, 'out', a.out)),
            a -> a.out), array())))""")
    return rows.select("row", "doc_id", F.explode(spans).alias("s")).select("row", "doc_id", "s.*").where("size(words) > 0")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    # Not by index in a lambda: there the words would be split anew for each pair.
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    out = spark.createDataFrame(rows, "family string, number int, paragraph string").withColumn("words", _words(F.col("paragraph")))
    return out.withColumn("bigrams", F.array_distinct(_bigrams(F.col("words"))))


def _telling(bigrams: list[str]) -> list[str]:
    """Bigrams of a template of which a paragraph that confirms it has one: those
    with a word of six letters, if they are more than may be missing, or all."""
    rare = [b for b in bigrams if max(map(len, b.split(" "))) >= 6]
    return rare if len(rare) > (1 - COVERED) * len(bigrams) else bigrams


def _telling_words(known: list[list[str]]) -> list[str]:
    """One word of each telling bigram: a paragraph without any confirms nothing."""
    telling = {b for bigrams in known for b in _telling(bigrams)}
    return sorted({max(b.split(" "), key=lambda w: (w.isdigit(), len(w), w)) for b in telling})


def _candidates(rows: DataFrame, known: list[list[str]]) -> DataFrame:
    """The paragraphs that may confirm one of the templates (lists of bigrams)."""
    telling = sorted({b for bigrams in known for b in _telling(bigrams)})
    some = rows.withColumn("bigrams", _bigrams(F.col("words")))
    return some.where(F.arrays_overlap("bigrams", F.lit(telling)))


def _lines_sample(docs: DataFrame, text_col: str) -> DataFrame:
    """The words of the ``LINES`` different lines with the smallest hashes: the hashes
    first, then the lines that have them."""
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).withColumn("key", F.xxhash64("line"))
    keys = lines.where("line <> ''").groupBy("key").agg(F.count("*").alias("n")).orderBy("key").limit(LINES).select("key")
    found = lines.join(F.broadcast(saved(keys)), "key").groupBy("key").agg(F.min("line").alias("line"))
    return found.select(_words(F.col("line")).alias("words")).where("size(words) > 0")


def train(spark: SparkSession, rows: DataFrame, templates: DataFrame):
    """The fitted classifier, its calibration (slope, intercept) and its families."""
    families = [*TEMPLATES, "unknown"]
    # Each template whole and with every k-th word left out, at several offsets.
    cuts = F.explode(F.expr("flatten(array(array(struct(1000 as every, 999 as at)), flatten(transform(sequence(3, 7), k -> transform(sequence(0, k - 1), a -> struct(k as every, a as at))))))"))
    thin = F.expr("filter(words, (w, i) -> i % cut.every <> cut.at)")
    known = templates.select("family", "words", cuts.alias("cut")).select("family", thin.alias("words"))
    fixed = spark.createDataFrame([(t,) for t in OTHERS], "paragraph string").select(F.lit("unknown").alias("family"), _words(F.col("paragraph")).alias("words"))
    other = rows.where(~F.arrays_overlap(F.lit(["license", "licensed", "licence", "licensed", "copyright", "reserved", "mit", "apache", "gnu", "cc", "spdx"]), "words"))
    # A line of a wrapped notice is no example of an unknown paragraph.
    of_notices = F.lit(sorted({b for r in templates.select("bigrams").collect() for b in r.bigrams}))  # a fixed list
    bigrams = _bigrams(F.col("words"))
    other = other.select("words").where((F.size(bigrams) == 0) | (2 * F.size(F.array_intersect(bigrams, of_notices)) < F.size(F.array_distinct(bigrams)))).distinct()
    # The paragraphs of the smallest hashes: the same sample wherever it is drawn.
    key = F.xxhash64(F.array_join("words", " "))
    other = other.orderBy(key, F.array_join("words", " ")).limit(MAX_UNKNOWN).select(F.lit("unknown").alias("family"), "words")
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    data = known.union(fixed).union(other).select(label.alias("label"), F.concat("words", _bigrams(F.col("words"))).alias("grams"))
    # A bounded sample in one partition: each of the fit's many passes is one task.
    data = saved(data.coalesce(1).withColumn("held", F.pmod(F.xxhash64("label", F.array_join("grams", " ")), F.lit(4)) == 0))
    model = Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES),
        LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60),
    ]).fit(data.where("not held"))
    scored = model.transform(data.where("held")).select(
        _margin("probability").alias("margin"), (F.col("prediction") == F.col("label")).cast("double").alias("right")
    )
    # Two counts of each side keep the fit finite where all are right.
    soft = spark.createDataFrame([(m, r) for m in (0.0, 0.5, 1.0) for r in (0.0, 1.0)], "margin double, right double")
    soft = soft.union(spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)] * 5, "margin double, right double"))
    as_vector = HashingTF(inputCol="m", outputCol="x", numFeatures=2)
    scored = scored.union(soft).withColumn("m", F.array_repeat(F.lit("margin"), (F.col("margin") * 100).cast("int")))
    line = LogisticRegression(featuresCol="x", labelCol="right", regParam=1e-4, standardization=False, maxIter=15).fit(as_vector.transform(scored))
    slope = float(max(line.coefficients)) * 100
    return model, (slope, float(line.intercept)), families


def _margin(probability: str) -> Column:
    """Difference of the two largest class probabilities."""
    p = F.sort_array(vector_to_array(F.col(probability)), asc=False)
    return p[0] - p[1]


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per confirmed notice: doc_id, line, family, confidence, covered. Predictions
    that are not confident or not confirmed have the family ``unknown``."""
    spark = docs.sparkSession
    prepare(spark)
    templates = _templates(spark)
    known = [(r.family, r.bigrams) for r in templates.select("family", "bigrams").collect()]  # a fixed list
    model, (slope, intercept), families = train(spark, _lines_sample(docs, text_col), templates)
    telling = _telling_words([bigrams for _, bigrams in known])
    spans = _spans(docs, id_col, text_col, 2 * max(len(bigrams) + 1 for _, bigrams in known), telling)
    found = _candidates(spans, [bigrams for _, bigrams in known]).withColumn("grams", F.concat("words", "bigrams"))
    found = model.transform(found).select(
        "row",
        "doc_id",
        "line",
        "n_lines",
        "bigrams",
        F.element_at(F.array(*map(F.lit, families)), F.col("prediction").cast("int") + 1).alias("guess"),
        (1 / (1 + F.exp(-(slope * _margin("probability") + intercept)))).alias("confidence"),
    )
    by_family = F.create_map(*(F.lit(v) for family in TEMPLATES for v in (family, [b for f, b in known if f == family])))
    shares = F.transform(by_family[F.col("guess")], lambda t: F.size(F.array_intersect(t, F.col("bigrams"))) / F.size(t))
    found = found.withColumn("covered", F.coalesce(F.array_max(shares), F.lit(0.0)))
    sure = (F.col("guess") != "unknown") & (F.col("confidence") >= CONFIDENT) & (F.col("covered") >= COVERED)
    found = found.withColumn("family", F.when(sure, F.col("guess")).otherwise("unknown")).where("n_lines = 1 or family <> 'unknown'")
    # Joined lines count where no line and no shorter join of theirs is a notice.
    one = F.struct("n_lines", (-F.col("covered")).alias("uncovered"), "line", "family", "confidence")
    by_row = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(one)).alias("all"))
    kept = F.expr("""concat(filter(all, x -> x.family = 'unknown'), aggregate(filter(all, x -> x.family <> 'unknown'), slice(all, 1, 0),
        (a, x) -> if(x.n_lines > 1 and exists(a, y -> x.line < y.line + y.n_lines and y.line < x.line + x.n_lines), a, concat(a, array(x)))))""")
    out = by_row.select("doc_id", F.explode(kept).alias("x"))
    return out.select("doc_id", "x.line", "x.family", "x.confidence", (-F.col("x.uncovered")).alias("covered"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its confirmed licence families and how many notices it has."""
    docs = table(spark, sf_dir, "documents")
    found = classify(docs).where("family <> 'unknown'")
    per_doc = found.groupBy("doc_id").agg(
        F.count("*").alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),  # at most one of each family
        F.min("confidence").alias("least_confidence"),
    )
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("families", F.lit("")).alias("families"), "least_confidence"
    )
