import math
import random

import pytest
import regex

from barloom.llm import licences

# Lines written apart from the names, leads and sentences that the classifier is trained on.
NOTICES = [
    ("This project is covered by the MIT licence; see COPYING for details.", "mit"),
    ("Copyright (c) 2014 J. Doe. MIT licensed.", "mit"),
    ("Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.", "mit"),
    (" * Licensed to the Foundation under the Apache License, Version 2.0 (the License);", "apache"),
    ("Everything in this folder falls under Apache License 2.0 unless noted.", "apache"),
    ("The software is made available to you under the terms of the Apache 2.0 license.", "apache"),
    ("All articles here: Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("Photos by the author, CC BY-SA 4.0, may be shared with credit.", "cc-by-sa"),
    ("The images of this book are CC BY 4.0.", "cc-by"),
    ("Text and figures may be reused: Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Songs are free for private use, CC BY-NC 4.0.", "cc-by-nc"),
    ("This program comes with source; GNU General Public License, version 3 or any later version applies.", "gpl"),
    ("You can change and pass it on as the GNU General Public License allows.", "gpl"),
    ("Linking is allowed by the GNU Lesser General Public License.", "lgpl"),
    ("The server is offered under the GNU Affero General Public License.", "agpl"),
    ("This file is part of the tool and is under the Mozilla Public License, version 2.0.", "mpl"),
    ("The data were dedicated to the public by CC0 1.0.", "cc0"),
    ("The parser is under a BSD 3-Clause License, like the rest.", "bsd"),
    ("Redistribution and use in source and binary forms are permitted provided the notice is retained.", "bsd"),
    ("This tool has an ISC license.", "isc"),
]
OTHERS = [
    "He asked whether a licence to fish was needed on this river.",
    "The committee released its report on general public health.",
    "We may copy the plans and use them for the new house.",
    "The version of events that she gave was never published.",
    "By 2004 the library held two million books, free to all.",
    "An Apache chief met the general near the old road.",
    "Without any warning the software stopped in the middle of the night.",
    "The permission of the owner was never asked, and no copies were kept.",
    "Terms were agreed, and the conditions of the sale were put in writing.",
    "The foundation of the house was laid in the first version of the plan.",
]


@pytest.fixture(scope="module")
def detector(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_independent_notices(spark, detector):
    rows = [(i, t) for i, (t, _) in enumerate(NOTICES)] + [(100 + i, t) for i, t in enumerate(OTHERS)]
    found = {r.i: r.licence for r in licences.paragraphs(spark.createDataFrame(rows, "i int, text string"), detector).collect()}
    right = sum(found.get(i) == family for i, (_, family) in enumerate(NOTICES))
    wrong = sum(found.get(i, "unknown") not in (family, "unknown") for i, (_, family) in enumerate(NOTICES))
    assert right >= 0.7 * len(NOTICES) and wrong <= 1, [(t, found.get(i)) for i, (t, _) in enumerate(NOTICES)]
    assert sum(100 + i in found for i in range(len(OTHERS))) <= 1, found


def test_unknown_names_are_no_family(spark, detector):
    rng = random.Random(9)
    made = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)).title() for _ in range(60)]
    rows = [(i, f"You may use it under the {name} License.") for i, name in enumerate(made)]
    found = licences.paragraphs(spark.createDataFrame(rows, "i int, text string"), detector).collect()
    assert sum(r.licence != "unknown" for r in found) <= 2
    assert 0.3 < detector.threshold < 1


def slow(detector, text):
    toks = [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]
    own = {" ".join(toks[i : i + n]) for n in (1, 2, 3) for i in range(len(toks) - n + 1)}
    weights, raw = detector.regression.coefficientMatrix.toArray(), detector.regression.interceptVector.toArray().copy()
    for k, gram in enumerate(detector.vectors.vocabulary):
        if gram in own:
            raw += weights[:, k]
    best = int(raw.argmax())
    return detector.classes[best], 1 / sum(math.exp((x - raw[best]) / detector.temperature) for x in raw)


def test_scores_equal_the_plain_sum_of_weights(spark, detector):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    lines = [line for r in docs.collect() for line in (r.text or "").split("\n")][:400]
    rng = random.Random(1)
    grams = sorted(detector.grams)
    lines += [" ".join(rng.choices(grams, k=rng.randrange(1, 12))) for _ in range(200)] + [t for t, _ in NOTICES] + OTHERS
    rows = list(enumerate(lines))
    found = licences.paragraphs(spark.createDataFrame(rows, "i int, text string"), detector).collect()
    got = {(r.i, r.line): (r.said, r.probability) for r in found}
    expect = {}
    for i, line in rows:
        said, p = slow(detector, line)
        if said != "none":
            expect[i, 0] = said, p
    assert got.keys() == expect.keys() and len(expect) > 100
    for key, (said, p) in expect.items():
        assert got[key][0] == said and got[key][1] == pytest.approx(p, abs=1e-9)


def test_columns_with_clashing_names(spark, detector):
    names = ["line", "grams", "rawPrediction", "said", "features", "probability", "prediction", "family", "shapes", "row"]
    row = ["Licensed under the MIT License.", *(f"{n}!" for n in names)]
    df = spark.createDataFrame([row], ["text", *names])
    (got,) = licences.paragraphs(df, detector).collect()
    assert (got.line, got.licence, got.said) == (0, "mit", "mit")
    assert all(got[n] == f"{n}!" for n in names if n not in ("line", "said", "probability"))




def test_names_whose_words_are_common_in_the_corpus_are_still_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lines = []
    for i in range(1500):
        at = [word() for _ in range(6)]
        if i % 3 == 0:  # a source of software notes
            at[1:1] = [rng.choice(("apache", "apache server", "released", "under", "under load", "released apache"))]
        lines.append((i, " ".join(at)))
    detector = licences.fit(spark.createDataFrame(lines, "doc_id long, text string"))
    rows = [(1, "Released under Apache 2.0"), (2, "the apache server was released"), (3, lines[0][1])]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), detector).collect()
    assert sorted((r.doc_id, r.licences) for r in got) == [(1, ["apache"]), (2, []), (3, [])]


def test_scan(spark, detector):
    plain = "Nothing of the kind stands here, only prose about the sea and the hills."
    rows = [
        (1, f"{plain}\nReleased under the MIT License.\n{plain}", "c"),
        (2, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "c"),
        (3, plain, "c"),
        (4, None, "c"),
        (5, "", "c"),
        (None, "This work is licensed under the GNU General Public License, version 3.", "c"),
        (6, f"{plain}\nLicensed under the Foo Barbaz License.", "c"),
        (7, "She lost her driving license at MIT.", "c"),
        (1, f"{plain}\nReleased under the MIT License.\n{plain}", "c"),
        (8, ("word " * 50 + "\n") * 3000 + "Released under the MIT License.", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = [(r.doc_id, r.licences, r.n_unknown, r.lines) for r in licences.scan(df, detector).collect()]
    assert sorted(map(str, got)) == sorted(
        map(
            str,
            [
                (1, ["mit"], 0, [1]),
                (1, ["mit"], 0, [1]),
                (2, ["apache", "cc-by-nc"], 0, [0, 1]),
                (3, [], 0, []),
                (4, [], 0, []),
                (5, [], 0, []),
                (None, ["gpl"], 0, [0]),
                (6, [], 1, [1]),
                (7, [], 0, []),
                (8, ["mit"], 0, [3000]),
            ],
        )
    )
    assert licences.scan(df.limit(0), detector).count() == 0
