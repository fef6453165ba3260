import random

from pyspark.sql import functions as F

from barloom.llm import jaccard


def slow_set(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def like(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def slow_roots(rows):
    sets, group = [slow_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and like(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def corpus(seed=5, n=260):
    """Texts and copies of them with a passage replaced: similarities from about 0.6 to 1."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([2, 8, 60, 200]))]
        if rows and rng.random() < 0.7:
            words = rows[rng.randrange(len(rows))][1].split(" ")
            cut = int(len(words) * rng.uniform(0, 0.2))
            at = rng.randint(0, len(words) - cut)
            words[at : at + cut] = [word() for _ in range(cut)]
        rows.append((i, " ".join(words)))
    return rows


def expected(rows):
    low = {}
    for (i, _), g in zip(rows, slow_roots(rows)):
        low[g] = min(low.get(g, i), i)
    return sorted(low.values())


def test_groups_are_those_of_brute_force_jaccard(spark):
    rows = corpus()
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[3][1].upper())]
    sets = [slow_set(t) for _, t in rows]
    shares = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a != b and len(a) > 40 and len(b) > 40]
    assert sum(0.8 <= s < 0.9 for s in shares) > 20 and sum(0.7 <= s < 0.8 for s in shares) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == expected(rows)
    assert sorted(r.doc_id for r in jaccard.keep_one(df, unit_rows=5).collect()) == expected(rows)


def test_the_stage_of_the_pipeline_drops_copies_of_similarity_point_eight(spark):
    import corpus_pipeline

    rows = corpus(6, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == expected(rows)


def test_equal_ids_and_rows_without_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    near = a + " end"
    rows = [(1, a), (1, b), (1, near), (1, a), (2, near), (None, a), (None, a), (3, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text[0]) for r in jaccard.keep_one(df).collect()), key=str)
    assert got == [(1, "a"), (1, "b"), (None, "a"), (None, "a")]
    assert jaccard.keep_one(df.limit(0)).count() == 0
