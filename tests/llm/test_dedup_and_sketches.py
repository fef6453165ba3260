import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import components, simhash, sketch, urls

SCHEMA = "doc_id long, text string, fp string, component_id string"


def corpus(seed: int = 1, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé ñ") for _ in range(4)).replace(" ", "o") for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 60, 200]))]
        if rows and rng.random() < 0.4:  # a near copy
            words = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
        rows.append((i * 3, " ".join(words), "x", "y"))
    rows += [(1, None, "", ""), (2, "", "", ""), (4, " \t\n", "", ""), (None, rows[0][1], "", ""), (None, "alone here it stands", "", "")]
    rows += [rows[5], rows[5], (5, "LONG " * 30_000, "", ""), (7, "A b C\x0bd e", "", "")]
    return rows


def slow_print(text: str | None, width: int) -> int:
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, width, radius):
    prints = [slow_print(t, width) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, *_), g in zip(rows, group):
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    return sorted(((r[0], p, low[g]) for r, p, g in zip(rows, prints, group)), key=str)


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4, radius=4)
    got = sorted(((r[0], r[1] % 2**64, r[2]) for r in found.collect()), key=str)
    assert got == slow_components(rows, 4, 4)


def test_links_of_split_units_connect_the_same(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = {int(b) for b in base}
    for _ in range(300):  # walks away from few centres: dense units
        at = list(fps)[rng.integers(len(fps))]
        for bit in rng.integers(0, 64, 3):
            at ^= 1 << int(bit)
        fps.add(at)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")

    def roots(links):
        return sorted(map(tuple, components.components(links, "a", "b").collect()))

    whole = roots(simhash.links(table))
    assert whole == roots(simhash.links(table, unit_rows=20))
    fps = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) % 2**64).bit_count() <= 4]
    assert whole == roots(spark.createDataFrame(pairs, "a long, b long"))


def test_dense_unit_gives_a_forest():
    fps = np.unique(np.array([(1 << a) | (1 << b) for a in range(20) for b in range(20)], dtype=np.uint64))
    a, b = simhash.unit_links(np.zeros(len(fps), np.int64), fps, simhash.pivot_set(16, 7), 4)
    assert len(a) == len(fps) - 1
    assert (np.bitwise_count(a ^ b) <= 4).all()


def test_keep_one_and_empty(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(df, width=5)
    assert kept.columns == df.columns
    expect = sorted({r[2] for r in slow_components(rows, 5, 4) if r[2] is not None})
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == expect
    assert kept.filter("doc_id is null").count() == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (60, None)]
    got = dict(components.components(spark.createDataFrame(links, "p long, q long"), "p", "q").collect())
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100)}


def test_edited_likeness(spark):
    rows = [r for r in corpus(3, 60) if r[0] is not None and r[0] not in (15,)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in sketch.edited_likeness(df).collect()}
    texts = [(i, t or "") for i, t, *_ in sorted(rows, key=lambda r: r[0])]
    for (i, text), (_, after) in zip(texts, texts[1:] + texts[:1]):
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].edited == edited and got[i].n_chars == len(text)
        if text == edited:
            assert got[i].near_edited == 1
        if text == after:
            assert got[i].near_next == 1
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    single = sketch.edited_likeness(spark.createDataFrame([(9, "one two three four")], "doc_id long, text string")).first()
    assert (single.edited, single.near_next) == ("one two three " + "one ", 1)
    assert sketch.edited_likeness(df.limit(0)).count() == 0


def test_rows_without_or_with_equal_ids_follow_each_other(spark):
    rows = [(None, "a"), (2, "b"), (2, "c"), (2, "b"), (5, None)]
    got = sketch.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert got == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 50])
def test_ranges_of_ids_are_found_among_the_cuts(spark, n):
    cuts = [float(3 * i) for i in range(n)]
    df = spark.range(-2, 160).withColumn("at", sketch._upto(cuts, F.col("id").cast("double")))
    assert all(r["at"] == sum(c <= r["id"] for c in cuts) for r in df.collect())


def test_next_rows_across_many_ranges(spark):
    rng = random.Random(8)
    ids = rng.sample(range(10_000), 700)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").repartition(7)
    got = {r["id"]: r["next_text"] for r in sketch.with_next(df, "id", ["text"], "text", per_partition=30).collect()}
    ids.sort()
    assert got == {i: f"t{j}" for i, j in zip(ids, ids[1:] + ids[:1])}


def test_sketches_estimate_containment_and_merge(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6000)]
    long, short, other = " ".join(words[:4000]), " ".join(words[1000:1800]), " ".join(words[4500:])
    df = spark.createDataFrame([(long, short, other)], "l string, s string, o string")
    s = {c: sketch.sketch(F.col(c)) for c in "lso"}
    row = df.select(
        sketch.containment(s["l"], s["s"]).alias("inside"),
        sketch.containment(s["l"], s["o"]).alias("apart"),
        (sketch.merge(s["l"], s["s"]) == s["l"]).alias("absorbed"),
        F.size(s["l"]).alias("n"),
    ).first()
    assert row.inside == 1 and row.apart == 0 and row.absorbed
    assert 0.7 < row.n / (4000 / 8) < 1.3


RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
    ("block", "example.com", "/de/private"),
    ("block", "Deep.a.example.org", ""),
    ("allow", None, "/"),
    ("block", "net", "/"),
]
PARTS = ["http://", "HTTPS://", "://", "", "x", "example.net", "EXAMPLE.com", "a.example.com", "b.deep.a.example.org", "org", "myorg", "net", "/", "//", "/en/", "/de/", "/de/private1", "/fr/x", "?q=/de/", "#top", ".", "\n", "é"]


def slow_verdict(url):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [
        (len(h) + len(p), len(h), v == "block", h.lower() + p, v)
        for v, h, p in RULES
        if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_rules(spark):
    rng = random.Random(2)
    urls_ = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 6))) for _ in range(800)]
    urls_ += [rng.choice(PARTS[:2]) + rng.choice(PARTS[5:12]) + rng.choice(PARTS[12:18]) + rng.choice(PARTS[12:]) for _ in range(800)]
    urls_ += [None, "", "http://net" + "/" * 50_000, "http://" + "a." * 20_000 + "net/x"]
    rows = [(i // 2, u, "clash") for i, u in enumerate(urls_)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = sorted(map(str, (tuple(r) for r in urls.judge(df, rules).collect())))
    assert got == sorted(str((i, *slow_verdict(u))) for i, u, _ in rows)
    assert urls.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(df, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("text", ["", "a b", "ab cd ef", None])
def test_short_texts_have_sketches(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(sketch.sketch(F.col("t")).alias("s")).first()
    assert len(row.s) == (1 if text else 0)


def test_sha_of_edited_is_over_utf8(spark):
    df = spark.createDataFrame([(1, "é" * 8), (2, "ñ")], "doc_id long, text string")
    row = sketch.edited_likeness(df).select("doc_id", F.sha2("edited", 256).alias("h")).filter("doc_id = 1").first()
    assert row.h == hashlib.sha256(("é" * 6 + "ñ").encode()).hexdigest()
