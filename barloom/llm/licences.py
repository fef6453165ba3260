"""Licence statements found by a trained paragraph classifier, as DataFrame functions and Spark ML only.

Each line of a text is a paragraph.  A multinomial logistic regression over sparse word
n-grams gives it a licence family, ``other`` (a licence of no known family) or ``none``.  Names, leads and
sentences that a first model has never seen calibrate it: one temperature for its
probabilities, and a threshold below which a licence counts as unknown; the model is then
fitted on all of them.  A family must also be confirmed by comparison with its templates.

Only lines with an n-gram that has a weight are scored; without one the intercepts say ``none``.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import bind
from barloom.session import materialize

# Names of licences, and the sentences that their notices use.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL", "AGPL-3.0", "GNU AGPL version 3"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause", "modified BSD license", "simplified BSD license"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "CC BY 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 License", "CC BY-NC 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 4.0 License", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0", "CC0-1.0", "Creative Commons Zero", "CC0 1.0 Universal Public Domain Dedication"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License", "GPL-3.0", "GPLv2", "GNU GPL version 2 or later", "GPL v3"],
    "isc": ["ISC License", "ISC", "ISC licence"],
    "lgpl": ["GNU Lesser General Public License", "LGPL", "LGPL-2.1", "GNU LGPL version 3", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT", "MIT licence", "Expat License", "X11 License"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License"],
}
SENTENCES = {
    "agpl": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": [
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "lgpl": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ],
}
LEADS = [
    "Licensed under {}",
    "Licensed under the {}",
    "Released under {}",
    "Released under the {}",
    "This work is licensed under the {}",
    "This work is licensed under a {}",
    "This software is distributed under the terms of the {}",
    "Available under the {}",
    "The code is published under {}",
    "SPDX-License-Identifier: {}",
    "License: {}",
    "Distributed under the {}, see the file LICENSE",
    "You may use this text under the {}",
]
# Sentences that use the words of licences for something else.
ELSEWHERE = [
    "A driving license is needed to rent a car",
    "The students at MIT published a paper on free software",
    "The apache helicopters flew under the clouds",
    "She was released under the condition that she would return",
    "The general public was free to visit the library",
    "The gnu is an antelope that lives in the open plains",
    "The restaurant lost its license to sell wine",
    "You can copy this recipe and use it for any purpose",
    "The court granted permission without any warranty",
    "The version of the story published here is distributed by the author",
    "Creative work in the commons is open to the public",
    "The fishing licence costs three pounds and is available under the counter",
]
NONE, OTHER, UNKNOWN = "none", "other", "unknown"


@dataclass(frozen=True)
class Detector:
    """A fitted classifier: vocabulary, regression, class names, calibration, the weighted n-grams and a word of each."""

    vectors: CountVectorizerModel
    regression: LogisticRegressionModel
    classes: tuple[str, ...]
    temperature: float
    threshold: float
    grams: tuple[str, ...]
    words: tuple[str, ...]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def grams(toks: Column, *sizes: int) -> Column:
    """Distinct word n-grams of the given sizes, space-joined."""

    def of(t: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        some = F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, some).otherwise(F.array().cast("array<string>"))

    return bind(toks, lambda t: F.array_distinct(F.concat(*(of(t, n) for n in sizes))))


def authored(spark: SparkSession, filler: list[str], per_lead: int = 6, seed: int = 3) -> DataFrame:
    """Labelled paragraphs (text, family, unseen) made from the fixed names and sentences; the same on every run.

    ``filler``: words to put around notices, from the texts that will be searched.  ``other`` has
    notices of licences with made-up names.  ``unseen`` marks rows with the last name, lead or
    sentence of their kind, which a model for calibration must not be fitted on.
    """
    rng = random.Random(seed)

    def around(low: int, high: int) -> str:
        return " ".join(rng.choice(filler) for _ in range(rng.randint(low, high))) if filler else ""

    def made() -> str:
        return "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(3, 5))).title()

    def last(items: list[str], item: str, kept: int = 2) -> bool:
        return len(items) > kept and items.index(item) >= len(items) - max(1, len(items) // 4)

    rows = []
    for family, names in NAMES.items():
        for lead in LEADS:
            for name in names:
                text, unseen = lead.format(name), last(names, name) or last(LEADS, lead)
                rows.append((text + rng.choice((".", "", ".")), family, unseen))
                wrapped = (f"{around(1, 8)}. {text}.", f"{text}. {around(1, 8)}", f"Copyright {rng.randint(1990, 2030)} {around(1, 3)}. {text}")
                rows.append((rng.choice(wrapped), family, unseen))
        sentences = SENTENCES.get(family, [])
        for sentence in sentences:
            words = sentence.split()
            for _ in range(per_lead * 3):
                at = rng.randint(0, max(0, len(words) - 7))
                cut = words[at : at + rng.randint(6, len(words))] if rng.random() < 0.5 else words
                rows.append((" ".join(cut), family, last(sentences, sentence)))
    for lead in LEADS:
        for _ in range(per_lead * 8):
            name = " ".join(made() for _ in range(rng.randint(1, 2)))
            kinds = (f"{name} License", f"{name} Public License {rng.randint(1, 4)}.0", f"{name}-{rng.randint(1, 3)}.0", f"{name} Open License")
            rows.append((lead.format(rng.choice(kinds)), OTHER, last(LEADS, lead)))
    for sentence in ELSEWHERE:
        for _ in range(per_lead * 4):
            text = rng.choice((f"{around(0, 6)} {sentence}", f"{sentence} {around(0, 6)}", sentence))
            rows.append((text, NONE, last(ELSEWHERE, sentence)))
    return spark.createDataFrame(rows, "text string, family string, unseen boolean")


def templates(spark: SparkSession) -> DataFrame:
    """(family, shapes): the word pairs of every template of a family, as array<array<string>>."""
    rows = []
    for family, names in NAMES.items():
        texts = [*names, *(lead.format(n) for lead in LEADS[:6] for n in names), *SENTENCES.get(family, [])]
        rows.append(F.struct(F.lit(family).alias("family"), F.array(*map(F.lit, texts)).alias("texts")))
    listed = spark.range(1).select(F.inline(F.array(*rows)))
    return listed.select("family", F.transform("texts", lambda t: grams(tokens(t), 1, 2)).alias("shapes"))


def likeness(toks: Column, shapes: Column) -> Column:
    """Best share, over the templates, of the smaller side's n-grams that the other side has."""

    def best(own: Column) -> Column:
        each = F.transform(
            shapes, lambda s: F.size(F.array_intersect(own, s)) / F.greatest(F.least(F.size(own), F.size(s)), F.lit(1))
        )
        return F.array_max(each)

    return bind(grams(toks, 1, 2), best)


def _marked(text: Column) -> Column:
    return grams(tokens(text), 1, 2, 3)


def _sampled(texts: DataFrame, id_col: str, text_col: str, sample: int, seed: int) -> list[str]:
    """About ``sample`` of all lines, those whose hash of id and line number is low enough for their count."""
    breaks = F.length(F.col(text_col)) - F.length(F.translate(F.col(text_col), "\n", "")) + 1
    count = texts.agg(F.sum(breaks).alias("n")).first()["n"] or 1
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "text"))
    low = min(2**63 - 1, int(-(2**63) + sample / count * 2**64))
    drawn = lines.filter((F.xxhash64(F.lit(seed), "id", "at") <= low) & (F.length("text") > 0)).select("text")
    return sorted(r["text"] for r in drawn.collect())


def _picked(rows: DataFrame, none: float) -> tuple[list[str], dict[str, int], float]:
    """n-grams that speak for a licence (not numbers alone, twice as frequent there), their counts in plain lines, weight of ``none``."""
    sums = [
        F.count(F.when(F.col("label") < none, 1)).alias("lic"),
        F.count(F.when(F.col("label") == none, 1)).alias("rest"),
        F.count(F.when(F.col("sampled"), 1)).alias("plain"),
    ]
    many = rows.agg(*sums).first()
    shares = rows.select("label", "sampled", F.explode("grams").alias("gram")).groupBy("gram").agg(*sums).filter("lic >= 3").collect()
    picked = sorted(
        gram
        for gram, lic, rest, _ in shares
        if len(gram) > 1 and not gram.isdigit() and lic / many["lic"] >= 2 * rest / max(many["rest"], 1)
    )
    # Outside the training set nearly all paragraphs are no licences.
    return picked, {r["gram"]: r["plain"] for r in shares}, 10.0 * many["lic"] / max(many["rest"], 1)


def _trained(rows: DataFrame, picked: list[str], none: float, weight: float) -> tuple[CountVectorizerModel, LogisticRegressionModel]:
    weighted = rows.withColumn("weight", F.when(F.col("label") == none, weight).otherwise(1.0)).coalesce(2)
    vectors = CountVectorizerModel.from_vocabulary(picked, inputCol="grams", outputCol="features").setBinary(True)
    learner = LogisticRegression(
        family="multinomial", regParam=2e-5, elasticNetParam=1.0, maxIter=80, standardization=False, weightCol="weight"
    )
    return vectors, learner.fit(vectors.transform(weighted)).setProbabilityCol("").setPredictionCol("")


def fit(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, seed: int = 3) -> Detector:
    """Train and calibrate on authored paragraphs and about ``sample`` lines drawn from ``texts``.

    The drawn lines count as ``none``, except those with a word that only licence paragraphs have.  For the
    calibration a first model is fitted without the names, leads and sentences marked unseen and
    without a quarter of the drawn lines; these calibrate it.  The model returned is fitted on all rows.
    """
    spark = texts.sparkSession
    telling = r"(?i)licen[cs]e|copyright|\bspdx\b|public domain|\bwarranty\b"
    drawn = spark.createDataFrame([(t,) for t in _sampled(texts, id_col, text_col, sample, seed)], "text string")
    drawn = drawn.filter(~F.col("text").rlike(telling))
    filler = sorted(r[0] for r in drawn.select(F.explode(tokens(F.col("text")))).distinct().collect())
    made = authored(spark, filler, seed=seed).withColumn("sampled", F.lit(False))
    plain = drawn.select("text", F.lit(NONE).alias("family"), (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("unseen"), F.lit(True).alias("sampled"))
    classes = (*sorted(NAMES), OTHER, NONE)
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    rows = materialize(
        made.unionByName(plain).distinct().select("text", "unseen", "sampled", label.cast("double").alias("label"), _marked(F.col("text")).alias("grams")),
        "licence-paragraphs",
    )
    none = float(classes.index(NONE))
    seen = rows.filter("not unseen")
    picked, _, weight = _picked(seen, none)
    vectors, first = _trained(seen, picked, none, weight)
    scored = first.transform(vectors.transform(rows.filter("unseen"))).select("label", vector_to_array("rawPrediction").alias("raw"))
    scored = materialize(scored, "licence-held-out")
    steps = [0.5 + 0.1 * k for k in range(46)]
    own = F.col("label").cast("int")
    loss = (F.avg(-F.log(F.greatest(_share(F.col("raw"), t, lambda r: F.get(r, own)), F.lit(1e-12)))) for t in steps)
    losses = scored.agg(*(x.alias(f"at{k}") for k, x in enumerate(loss))).first()
    temperature = steps[min(range(len(steps)), key=lambda k: losses[k])]
    best = bind(F.col("raw"), lambda r: F.struct((F.array_position(r, F.array_max(r)) - 1).alias("said"), _share(r, temperature, F.array_max).alias("p")))
    threshold = _threshold(scored.select("label", F.inline(F.array(best))), len(NAMES))

    picked, known, weight = _picked(rows, none)
    vectors, regression = _trained(rows, picked, none, weight)
    weights, intercepts = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray()
    if int(intercepts.argmax()) != classes.index(NONE):
        raise ValueError("the classifier does not call a paragraph without evidence none")
    used = [gram for i, gram in enumerate(picked) if abs(weights[:, i]).max() > 0]
    words = {min(gram.split(), key=lambda w: (w.isdigit() or len(w) == 1, known.get(w, 0), w)) for gram in used}
    return Detector(vectors, regression, classes, temperature, threshold, tuple(used), tuple(sorted(words)))


def _share(raw: Column, temperature: float, of) -> Column:
    """The probability of the class whose score ``of`` picks."""
    return bind(
        raw, lambda r: bind(of(r), lambda own: 1 / F.aggregate(r, F.lit(0.0), lambda a, x: a + F.exp((x - own) / temperature)))
    )


def _threshold(scored: DataFrame, families: int, wrong: float = 0.01) -> float:
    """The lowest probability from which at most ``wrong`` of the held-out family predictions (said, p) are wrong."""
    rows = scored.filter(F.col("said") < families)
    steps = [0.30 + 0.01 * k for k in range(70)]
    bad = [F.count(F.when((F.col("p") >= t) & (F.col("said") != F.col("label")), 1)) for t in steps]
    taken = [F.count(F.when(F.col("p") >= t, 1)) for t in steps]
    got = rows.agg(*bad, *taken).first()
    for k, t in enumerate(steps):
        if got[k] <= wrong * got[len(steps) + k]:
            return t
    return steps[-1]


def paragraphs(df: DataFrame, detector: Detector, text_col: str = "text", confirm: float = 0.6) -> DataFrame:
    """All columns of ``df`` but the text, and one row per licence paragraph.

    Adds ``line`` (0-based), ``licence`` (family or ``unknown``), ``said`` (the classifier's word),
    ``probability`` and ``likeness``, in place of columns of these names.  A family below the threshold or
    unlike its templates is ``unknown``.

    What is computed for a line is generated, not projected: filters are not moved below a
    generator, so no expression is evaluated again on either side of one.
    """
    added = ("line", "licence", "said", "probability", "likeness")
    kept = [c for c in df.columns if c != text_col and c not in added]
    row = F.struct(*(F.col(c) for c in kept)) if kept else F.struct(F.lit(0).alias("__none"))
    opens = F.array(*map(F.lit, detector.words))

    def once(value: Column, name: str) -> Column:
        return F.inline(F.array(F.struct(value.alias(name))))

    split = F.transform(F.split(F.col(text_col), "\n"), tokens)
    lines = df.select(row.alias("__row"), F.posexplode(split).alias("__line", "__tokens"))
    lines = lines.filter(F.arrays_overlap("__tokens", opens))
    lines = lines.select("__row", "__line", "__tokens", once(grams(F.col("__tokens"), 1, 2, 3), "grams"))
    lines = lines.filter(F.exists("grams", lambda g: g.isin(*detector.grams)))
    scored = detector.regression.transform(detector.vectors.transform(lines))
    names = F.array(*map(F.lit, detector.classes))
    judged = bind(
        vector_to_array("rawPrediction"),
        lambda r: F.struct(
            F.get(names, (F.array_position(r, F.array_max(r)) - 1).cast("int")).alias("__said"),
            _share(r, detector.temperature, F.array_max).alias("__probability"),
        ),
    )
    found = scored.select("__row", "__line", "__tokens", F.inline(F.array(judged))).filter(F.col("__said") != NONE)
    shapes = templates(df.sparkSession)
    found = found.join(shapes, F.col("__said") == F.col("family"), "left").select(
        "__row", "__line", "__said", "__probability", once(F.coalesce(likeness(F.col("__tokens"), F.col("shapes")), F.lit(0.0)), "__likeness")
    )
    sure = (F.col("__said") != OTHER) & (F.col("__probability") >= detector.threshold) & (F.col("__likeness") >= confirm)
    licence = F.when(sure, F.col("__said")).otherwise(UNKNOWN)
    values = (F.col("__line"), licence, F.col("__said"), F.col("__probability"), F.col("__likeness"))
    return found.select(*(F.col("__row")[c].alias(c) for c in kept), *(v.alias(n) for v, n in zip(values, added)))


def scan(df: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: id_col, licences, n_licences, n_unknown, lines.

    licences: the families found, sorted, distinct; lines: their 0-based line numbers in
    order, of unknown licences too.  Null texts, empty texts and texts without licence paragraphs have empty
    arrays.  Repeated rows are repeated; an empty table gives none.
    """
    detector = detector or fit(df, id_col, text_col)
    keyed = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    # Rows of equal id and text have the same lines; they are counted once.
    hits = paragraphs(keyed, detector).groupBy("id", "digest").agg(
        F.array_sort(F.collect_set(F.when(F.col("licence") != UNKNOWN, F.col("licence")))).alias("licences"),
        F.count_distinct(F.when(F.col("licence") == UNKNOWN, F.col("line"))).alias("n_unknown"),
        F.array_sort(F.collect_set("line")).alias("lines"),
    )
    hits = hits.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "licences", "n_unknown", "lines")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    empty = F.array().cast("array<string>")
    return keyed.select("id", "digest").join(hits, same, "left").select(
        F.col("id").alias(id_col),
        F.coalesce("licences", empty).alias("licences"),
        F.coalesce(F.size("licences"), F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        F.coalesce("lines", F.array().cast("array<int>")).alias("lines"),
    )
