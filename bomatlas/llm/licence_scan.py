"""Licence scans: a trained paragraph classifier confirmed by template comparison.

Sparse logistic regression over words and pairs of words tells licence families apart, and
from an unknown class: notices of no known family and paragraphs of the corpus itself. The
threshold is calibrated on held-out unknown paragraphs, and a family only counts if the
paragraph also holds most of the words and pairs of one of the family's templates.

L1 leaves few n-grams with weight. From the weights follows which of them a paragraph must
have at least one of to reach the threshold; a text without any of those is unknown without
being split or scored. That shortcut is exact, not a guess.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomatlas.llm.common import stored

UNKNOWN = "unknown"
#: Documents whose paragraphs stand for ordinary text in training, by hash of their id: the bound of the sample.
SAMPLE_DOCUMENTS = 300
#: Share of held-out unknown paragraphs that may pass the threshold, and the least threshold.
FALSE_ACCEPTS, LEAST_PROBABILITY = 0.005, 0.5
#: Share of a template's words and pairs that a paragraph must hold.
LEAST_SIMILARITY = 0.7

#: Names under which licences are cited, by family.
NAMES = {
    "AGPL": ["the GNU Affero General Public License, version 3", "the AGPL v3", "AGPL-3.0"],
    "Apache": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache 2.0 license"],
    "BSD": ["the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "BSD-3-Clause"],
    "CC-BY": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC BY 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["CC0 1.0", "the Creative Commons Zero dedication", "the CC0 1.0 Universal public domain dedication"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL v3", "GPL-3.0", "the GPL version 2"],
    "ISC": ["the ISC License", "the ISC license terms"],
    "LGPL": ["the GNU Lesser General Public License, version 2.1", "the GNU LGPL v3", "LGPL-3.0"],
    "MIT": ["the MIT License", "the MIT license", "the MIT License (MIT)"],
    "MPL": ["the Mozilla Public License, version 2.0", "MPL-2.0", "the Mozilla Public License 2.0"],
}
#: Names that belong to no family.
OTHERS = ["the terms of the agreement", "a custom agreement", "the house rules", "licence number 4711", "the driving licence act", "terms to be agreed", "a commercial contract", "these conditions", "our terms of use"]
#: How notices cite a licence.
PHRASES = [
    "This work is licensed under {}.",
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under the terms of {}.",
    "This file is part of a project available under {}.",
    "The source code is published under {}; see the file LICENSE.",
    "You may use this text under {}.",
    "SPDX-License-Identifier: {}",
    "Copyright the authors. All rights granted under {}.",
]

#: Identifiers under which licences are declared, by family.
IDENTIFIERS = {
    "AGPL": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "Apache": ["Apache-2.0", "Apache-1.1"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause", "0BSD"],
    "CC-BY": ["CC-BY-4.0", "CC-BY-3.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC-BY-NC-3.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC-BY-SA-3.0"],
    "CC0": ["CC0-1.0"],
    "GPL": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"],
    "MPL": ["MPL-2.0", "MPL-1.1"],
}
_FREE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the "
    "Free Software Foundation, either version {1} of the License, or (at your option) any later version."
)
#: Headings, headers of files and paragraphs of the licences' own texts, by family.
TEXTS = {
    "AGPL": ["GNU Affero General Public License", _FREE.format("Affero ", "3")],
    "Apache": [
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "BSD 2-Clause License",
        "BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ],
    "CC0": ["CC0 1.0 Universal"],
    "GPL": ["GNU General Public License Version 2", "GNU General Public License Version 3", _FREE.format("", "2"), _FREE.format("", "3")],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "LGPL": ["GNU Lesser General Public License Version 2.1", "GNU Lesser General Public License Version 3", _FREE.format("Lesser ", "2.1"), _FREE.format("Lesser ", "3")],
    "MIT": [
        "MIT License",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
#: What stands around such texts; an n-gram is learned from three notices at least.
AROUND = ["{}", "Copyright (c) 2020 the authors. {}", "{} See the file for details."]


def _spaced(text: Column) -> Column:
    """The words of a text, a-z and 0-9 after lower-casing, each between single spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))


def _ngrams(spaced: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def templates(spark: SparkSession) -> DataFrame:
    """``family, template``: every phrase with every name, identifiers and licence texts; family ``unknown`` for the other names."""
    names = [*((family, name) for family, all_ in NAMES.items() for name in all_), *((UNKNOWN, name) for name in OTHERS)]
    rows = [(family, phrase.format(name)) for family, name in names for phrase in PHRASES]
    rows += [(family, f"SPDX-License-Identifier: {name}") for family, all_ in IDENTIFIERS.items() for name in all_]
    rows += [(family, text) for family, all_ in TEXTS.items() for text in all_]
    return spark.createDataFrame(rows, "family string, template string").distinct()


def _notices(spark: SparkSession) -> DataFrame:
    """The rows to learn from: :func:`templates`, with identifiers and texts as often as :data:`AROUND` has ways."""
    rows = [(family, way.format(text)) for family, all_ in TEXTS.items() for text in all_ for way in AROUND[1:]]
    rows += [(family, way.format(f"SPDX-License-Identifier: {name}")) for family, all_ in IDENTIFIERS.items() for name in all_ for way in AROUND[1:]]
    return templates(spark).unionByName(spark.createDataFrame(rows, "family string, template string"))


def _ordinary(documents: DataFrame) -> DataFrame:
    """Paragraphs of a bounded sample of documents, without those that speak of licences."""
    ids = documents.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCUMENTS)
    lines = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n+")).alias("template"))
    speaks = F.lower("template").rlike("licen|copyright|gnu|apache|creative commons|bsd|mozilla|public domain")
    return lines.where((F.trim("template") != "") & ~speaks).distinct().select(F.lit(UNKNOWN).alias("family"), "template")


@dataclass
class Classifier:
    vectors: CountVectorizerModel
    model: LogisticRegressionModel
    families: list[str]
    threshold: float
    #: Ordinary paragraphs of the sample that have a word of the vocabulary.
    ordinary: dict[str, int]

    def needed(self) -> list[str]:
        """N-grams one of which every paragraph has that reaches the threshold for some family.

        None if a paragraph without any n-gram reaches it, so that nothing can be left out.
        """
        weights, bias = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        vocabulary, other = self.vectors.vocabulary, self.families.index(UNKNOWN)
        known = [f for f in range(len(self.families)) if f != other]
        # P(family) >= t needs a lead of log(t / (1 - t)) over the unknown class.
        room = math.log(self.threshold / (1 - self.threshold)) - (bias[known] - bias[other])
        gains = np.maximum(weights[known] - weights[other], 0.0).T
        most = gains.max(axis=1)
        strong = []
        for i in sorted(np.flatnonzero(most > 0), key=lambda i: (most[i], vocabulary[i])):
            if not strong and (room > gains[i]).all():
                room = room - gains[i]  # all of these n-grams together don't reach the threshold
            else:
                strong.append(vocabulary[i])
        if (room <= 0).any():
            return []
        return sorted(strong)

    def rarest(self, ngram: str) -> str:
        """The word of an n-gram that ordinary paragraphs have least often."""
        return min(ngram.split(), key=lambda w: (self.ordinary.get(w, 0), -len(w), w))

    def scored(self, paragraphs: DataFrame) -> DataFrame:
        """``family`` and ``probability`` of the best class beside the unknown one, for rows with ``ngrams``."""
        known = [(f, i) for i, f in enumerate(self.families) if f != UNKNOWN]
        chances = vector_to_array("probability")
        out = self.model.transform(self.vectors.transform(paragraphs)).withColumn("_chances", chances)
        best = F.array_max(F.array(*[F.struct(F.element_at("_chances", i + 1).alias("probability"), F.lit(f).alias("family")) for f, i in known]))
        columns = [c for c in paragraphs.columns if c not in ("probability", "family")]
        return out.select(*columns, best.alias("_best")).select(*columns, "_best.family", "_best.probability")


def train(documents: DataFrame) -> Classifier:
    spark = documents.sparkSession
    families = sorted([*NAMES, UNKNOWN])
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = _notices(spark).unionByName(_ordinary(documents))
    held_out = F.pmod(F.xxhash64("template"), F.lit(5)) == 0
    rows = rows.select(number.cast("double").alias("label"), "family", _ngrams(_spaced(F.col("template"))).alias("ngrams"), held_out.alias("held_out"))
    rows = stored(rows.coalesce(2), "notices")
    learned = rows.where("not held_out or family <> 'unknown'")
    vectors = CountVectorizer(inputCol="ngrams", outputCol="features", binary=True, vocabSize=1 << 14, minDF=3).fit(learned)
    regression = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=5e-4, maxIter=60)
    model = regression.fit(vectors.transform(learned).select("label", "features"))
    counts = rows.where("family = 'unknown'").select(F.explode("ngrams").alias("word")).groupBy("word").count().where("count >= 3 and not contains(word, ' ')")
    classifier = Classifier(vectors, model, families, LEAST_PROBABILITY, {r["word"]: r["count"] for r in counts.collect()})
    unknown = classifier.scored(rows.where("held_out and family = 'unknown'").select("ngrams"))
    calibrated = unknown.agg(F.percentile("probability", 1 - FALSE_ACCEPTS)).first()[0] or 0.0
    classifier.threshold = min(max(LEAST_PROBABILITY, calibrated), 0.99)
    return classifier


def scan(documents: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """``doc_id, family, notices`` for every row of ``documents``.

    ``notices`` has a struct ``paragraph, family, probability, similarity`` for each paragraph
    (a run of characters without line end, or a block of lines with words, by its first line, of
    which no line is confirmed for the same family) whose family is confirmed, in order; ``family`` is that
    of the most probable one, the first of equals, or ``unknown``. Null and empty texts are unknown.
    Rows that share id and text share their answer. Other columns aren't read.
    """
    spark = documents.sparkSession
    classifier = classifier or train(documents)
    needed = classifier.needed()
    ngrams, words = (F.array(*[F.lit(w) for w in sorted(some)]) for some in (set(needed), {classifier.rarest(n) for n in needed}))

    def may_be_known(text: Column) -> Column:
        return F.lit(not needed) | F.arrays_overlap(F.split(_spaced(text), " "), words.cast("array<string>"))

    hashed = documents.select("doc_id", F.xxhash64("text").alias("_hash"), "text")
    split = hashed.where(may_be_known(F.col("text"))).select("doc_id", "_hash", F.split("text", "\n").alias("_lines"))
    # A line without words ends a block; each line with words that follows none begins one.
    worded = F.transform("_lines", lambda line: line.rlike("[A-Za-z0-9]"))
    begins = F.filter(
        F.transform("_worded", lambda w, i: F.when(w & ~F.coalesce(F.get("_worded", i - 1), F.lit(False)), i)), lambda i: i.isNotNull()
    )
    ends = F.filter(
        F.transform("_worded", lambda w, i: F.when(w & ~F.coalesce(F.get("_worded", i + 1), F.lit(False)), i)), lambda i: i.isNotNull()
    )
    ranges = F.filter(F.arrays_zip(begins.alias("first"), ends.alias("last")), lambda r: r["first"] < r["last"])
    blocks = F.transform(
        ranges, lambda r: F.struct(r["first"].alias("paragraph"), r["last"].alias("last"), F.array_join(F.slice("_lines", r["first"] + 1, r["last"] - r["first"] + 1), "\n").alias("line"))
    )
    single = F.transform("_lines", lambda line, i: F.struct(i.alias("paragraph"), i.alias("last"), line.alias("line")))
    lines = (
        split.withColumn("_worded", worded)
        .select("doc_id", "_hash", F.explode(F.concat(single, blocks)).alias("_part"))
        .select("doc_id", "_hash", "_part.*")
        .where(may_be_known(F.col("line")))
        .select("doc_id", "_hash", "paragraph", "last", _ngrams(_spaced(F.col("line"))).alias("ngrams"))
        .where(F.lit(not needed) | F.arrays_overlap("ngrams", ngrams.cast("array<string>")))
        .distinct()
    )
    likely = classifier.scored(lines).where(F.col("probability") >= classifier.threshold)
    marks = templates(spark).where(F.col("family") != UNKNOWN).select("family", _ngrams(_spaced(F.col("template"))).alias("_template"))
    similarity = F.size(F.array_intersect("ngrams", "_template")) / F.size("_template")
    sure = (
        likely.join(marks, "family")
        .groupBy("doc_id", "_hash", "paragraph", "last", "family", "probability")
        .agg(F.max(similarity).alias("similarity"))
        .where(F.col("similarity") >= LEAST_SIMILARITY)
    )
    alone = F.collect_set(F.when(F.col("paragraph") == F.col("last"), F.struct(F.col("paragraph").alias("at"), F.col("family").alias("of"))))
    sure = sure.withColumn("_alone", alone.over(Window.partitionBy("doc_id", "_hash")))
    told = F.exists("_alone", lambda x: (x["of"] == F.col("family")) & x["at"].between(F.col("paragraph"), F.col("last")))
    sure = sure.where((F.col("paragraph") == F.col("last")) | ~told)
    notice = F.struct("paragraph", "family", "probability", "similarity")
    found = sure.groupBy("doc_id", "_hash").agg(
        F.sort_array(F.collect_list(notice)).alias("notices"), F.max(F.struct("probability", -F.col("paragraph"), "family")).alias("_best")
    ).withColumnsRenamed({"doc_id": "_id", "_hash": "_of"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_hash").eqNullSafe(F.col("_of"))
    none = F.array().cast("array<struct<paragraph:int,family:string,probability:double,similarity:double>>")
    return hashed.select("doc_id", "_hash").join(found, same, "left").select(
        "doc_id", F.coalesce("_best.family", F.lit(UNKNOWN)).alias("family"), F.coalesce("notices", none).alias("notices")
    )
