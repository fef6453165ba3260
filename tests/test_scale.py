"""Steps that must not be repeated or multiplied as tables grow, and the results that must stay."""

import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import context as X
from barloom.operators import models as Z
from barloom.operators import ranking as R
from barloom.plans import q_models, q_panels


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_probe_rows_are_written_once_with_the_columns_asked_for(spark):
    df = q_panels.probe_frame(spark, "/root/testdata/sf0.01", ["dist_hi", "up"])
    assert df.columns == ["ticker", "date", "dist_hi", "up"]
    assert "Window" not in plan(df) and "Aggregate" not in plan(df)
    train, test = q_models._split(spark, "/root/testdata/sf0.01", ["dist_hi", "up"])
    assert "Window" not in plan(train) and "Window" not in plan(test)
    assert train.count() > 0 and train.agg(F.max("date")).first()[0] < test.agg(F.min("date")).first()[0]


def test_bias_variance_shuffles_the_scores_of_all_rounds_once(spark):
    rng = random.Random(3)
    rows = [(k % 40, datetime.date(2020, 1, 1) + datetime.timedelta(k // 40), rng.random(), rng.randrange(2)) for k in range(400)]
    df = spark.createDataFrame(rows, "ticker int, date date, x double, up int")
    out = Z.bias_variance(df, df, ["x"], "up", ["ticker", "date"], rounds=3)
    assert "Union" not in plan(out)
    row = out.first()
    assert 0 < row.variance < 0.05 and 0.2 < row.total < 0.3


@pytest.mark.parametrize("text", [False, True])
def test_pairs_are_finished_in_the_tasks_of_their_tiles(spark, monkeypatch, text):
    for name, size in (("TILE", 6), ("BLOCK_A", 2), ("BLOCK_B", 3)):
        monkeypatch.setattr(X, name, size)
    rng, series = random.Random(5), {}
    for k in range(31):
        days = rng.sample(range(40), rng.randrange(0, 30))
        series[f"t{k}" if text else k] = {d: 1.0 if k == 7 else rng.gauss(0, 1) for d in days}
    first = datetime.date(2020, 1, 1)
    rows = [(t, first + datetime.timedelta(d), x) for t, s in series.items() for d, x in s.items()]
    rows += [(None, first, 1.0), (next(iter(series)), first + datetime.timedelta(50), None)]
    df = spark.createDataFrame(rows, f"ticker {'string' if text else 'int'}, date date, r double")
    out = X.pair_correlation(df, "r")
    assert "Aggregate" not in plan(out) and "Window" not in plan(out)
    found = {(r.a, r.b): (r.n, r.rho) for r in out.collect()}
    expect = {}
    for a, b in itertools.combinations(sorted(series), 2):
        both = sorted(series[a].keys() & series[b].keys())
        if both:
            x, y = ([series[t][d] for d in both] for t in (a, b))
            expect[a, b] = (len(both), np.corrcoef(x, y)[0, 1] if len(both) > 1 and np.std(x) and np.std(y) else None)
    assert found.keys() == expect.keys() and out.count() == len(expect)
    for pair, (n, rho) in expect.items():
        assert found[pair][0] == n and (found[pair][1] is None if rho is None else abs(found[pair][1] - rho) < 1e-9)
    assert X.pair_correlation(df.limit(0), "r").count() == 0


def test_pairs_are_read_from_tiles_and_never_broadcast(spark):
    df = spark.range(600).select((F.col("id") % 6).cast("int").alias("ticker"), F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("id") / 6).cast("int")).alias("date"), F.rand(2).alias("r"))
    corr = X.pair_correlation(df, "r")
    assert corr.count() == 15 and "Exchange" not in corr._jdf.queryExecution().executedPlan().toString()
    assert int(str(corr._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > 1 << 40


def test_silhouettes_leave_the_pairs_where_they_lie(spark):
    pairs = spark.range(400).select((F.col("id") % 20).cast("int").alias("a"), (F.col("id") / 20).cast("int").alias("b"), F.rand(1).alias("rho"))
    dist = X.pair_distance(pairs.filter("a < b"))
    clusters = spark.range(20).select(F.col("id").cast("int").alias("a"), (F.col("id") % 3).alias("cluster")).join(spark.range(1).toDF("one"))
    assert "Union" not in plan(dist) and dist.count() == 380
    names = X.silhouettes(dist, clusters.select(F.lit(0).alias("k"), "a", "cluster"))
    text = names._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("pct", [True, False])
def test_ranks_of_groups_that_a_task_can_sort_move_rows_once(spark, monkeypatch, pct):
    rng = random.Random(8)
    value = lambda: rng.choice([None, float("nan"), -0.0, 0.0, 1.5, rng.gauss(0, 1)])
    rows = [(k, rng.choice([None, 1, 2, 3]), value(), value()) for k in range(300)]
    df = spark.createDataFrame(rows, "id int, g int, x double, y double")
    names = {"rx": "x", "ry": "y"}
    for by in (["g"], []):
        out = R.with_ranks(df, by, names, pct)
        assert out.columns == [*df.columns, *names]
        text = out._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "Join" not in text
        found = {r.id: (r.rx, r.ry) for r in out.collect()}
        with monkeypatch.context() as m:
            m.setattr(R, "RANGE_VALUES", 7)
            m.setattr(R, "WHOLE_RANGES", 0)
            expect = {r.id: (r.rx, r.ry) for r in R.with_ranks(df, by, names, pct).collect()}
        assert found.keys() == expect.keys()
        for k, pair in expect.items():
            assert all(a is b is None or abs(a - b) < 1e-12 for a, b in zip(found[k], pair)), (k, found[k], pair)
