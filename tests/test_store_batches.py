import datetime

import pytest

from barloom.session import scratch_path
from barloom.sources.store import FeatureStore

ROWS = [(t, datetime.date(2020, m, 1), 1.0 * t, 1) for t in (1, 2) for m in (1, 2, 3)] + [(1, datetime.date(2020, 1, 1), 1.0, 1)]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("compacted", [False, True])
def test_a_horizon_in_one_batch_is_read_without_a_shuffle(spark, compacted):
    store = FeatureStore(spark, scratch_path(spark, "store"))
    df = spark.createDataFrame(ROWS, "ticker int, date date, x double, y int")
    store.upsert(df, ["x"], "y", 1)
    store.upsert(df.limit(0), ["x"], "y", 1)
    for factor in (1, 10):
        store.upsert(df.withColumn("x", df.x * factor), ["x"], "y", 5)
    if compacted:
        store.compact()
    got = sorted((r.horizon, r.ticker, r.date.month, r.vec[0]) for r in store.current().collect())
    assert got == sorted((h, str(t), m, t * (10.0 if h == 5 else 1.0)) for h in (1, 5) for t in (1, 2) for m in (1, 2, 3))
    assert "Window" not in plan(store.load_range(1)) and store.load_range(1).count() == 6
    assert ("Window" in plan(store.load_range(5))) != compacted
