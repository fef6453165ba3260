import random

from pyspark.sql import functions as F

from barloom.llm import jaccard
from barloom.llm.common import sieved


def files(spark):
    """Size of each shuffle file of the session."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    sizes = {}
    for i in range(found.size()):
        if (f := found.apply(i)).getName().startswith("shuffle_"):
            sizes[f.getAbsolutePath()] = f.length()
    return sizes


def test_texts_like_no_other_are_not_shuffled(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(2000)) for _ in range(150)]
    rows = list(enumerate([*texts, texts[0], texts[1] + " end"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = files(spark)
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == list(range(150))
    moved = sum(size for path, size in files(spark).items() if path not in before)
    assert moved < sum(map(len, texts)) / 2


def test_a_sieve_passes_every_key_and_few_others(spark):
    df = spark.range(20_000).withColumn("name", F.when(F.col("id") % 7 > 0, F.concat(F.lit("x"), "id")))
    got = sieved(df, df.filter("id % 50 = 3"), "id", "name")
    assert got.columns == ["id", "name", "__maybe"]
    assert got.filter("id % 50 = 3 and __maybe").count() == 400
    assert got.count() == 20_000 and got.filter("__maybe").count() < 440
    assert sieved(df, df.limit(0), "id", "name").filter("not __maybe").count() == 20_000
    assert sieved(df, df, "name").filter("__maybe").count() == 20_000


def test_a_copy_that_repeats_in_a_task_still_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SEEN", 2)
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text), (4, text.upper()), (3, text + " end"), (9, "other"), (8, "other"), (7, None), (6, ""), (None, text)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(2)
    assert sorted((r.doc_id for r in jaccard.keep_one(df).collect()), key=str) == [3, 6, 8, None, None]
