import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import jaccard


def test_the_stage_finds_near_copies_by_fingerprints_alone(spark, monkeypatch):
    # No two sets share a band, so only the fingerprints can bring texts together.
    monkeypatch.setattr(jaccard, "band_keys", lambda found: np.random.default_rng().integers(-(2**62), 2**62, jaccard.BANDS))
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words) + " end"), (3, " ".join(f"x{i}" for i in range(400))), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, df, "").collect()) == [1, 3, 4]
