import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bands as D
from barloom.operators import timejoins as J
from barloom.sources import files
from barloom.sources.datasets import intraday_bars
from barloom.sources.store import FeatureStore, LedgerTable
from barloom.streaming import bars as B
from barloom.streaming.ledger import feed

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


# ---- joins ------------------------------------------------------------------------


@pytest.mark.parametrize("bucket", [7.0, 100.0, 1e6])
@pytest.mark.parametrize("tolerance", [None, 30.0])
def test_asof_equals_a_plain_search(spark, bucket, tolerance):
    rng = random.Random(int(bucket))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = [(i, key(), rng.choice([None, *range(0, 600)])) for i in range(300)] + [(5, "hot", 50), (5, "hot", 50)]
    right = [(key(), rng.choice([None, *range(0, 600, 3)]), rng.choice([None, 1, 2, 3])) for _ in range(80)]
    a = spark.createDataFrame([(i, k, at(t), "x") for i, k, t in left], "id int, k string, ts timestamp, v string")
    b = spark.createDataFrame([(k, at(t), v) for k, t, v in right], "k string, ts timestamp, v int")
    got = [(r.id, r.k, r.ts, r.v, r.asof_ts, r.asof_v) for r in J.asof_join(a, b, ["k"], "ts", tolerance, bucket).collect()]
    expect = []
    for i, k, t in left:
        fits = [(s, -1 if v is None else v) for own, s, v in right if own == k and None not in (k, t, s) and s <= t]
        s, v = max(fits, default=(None, None))
        if s is not None and tolerance is not None and t - s > tolerance:
            s, v = None, None
        expect.append((i, k, at(t), "x", at(s), None if v == -1 else v))
    assert sorted(map(str, got)) == sorted(map(str, expect))


def test_asof_of_empty_sides(spark):
    a = spark.createDataFrame([(1, at(5))], "k int, ts timestamp")
    assert J.asof_join(a, a.limit(0), ["k"], "ts").collect() == [(1, at(5), None)]
    assert J.asof_join(a.limit(0), a, ["k"], "ts").collect() == []


@pytest.mark.parametrize("finest", [1.0, 60.0])
def test_overlaps_equal_all_pairs(spark, finest):
    rng = random.Random(3)

    def spans(n):
        out = []
        for i in range(n):
            low = rng.randrange(0, 5000)
            out.append((i, rng.choice([1, 1, 2, None]), low, rng.choice([low, low + 1, low + rng.randrange(1, 50), low + rng.randrange(1, 40_000), None])))
        return out

    left, right = spans(150), spans(150)
    frame = lambda rows, s: spark.createDataFrame(
        [(i, k, at(a), at(b)) for i, k, a, b in rows], f"{s}_id int, k int, {s}0 timestamp, {s}1 timestamp"
    )
    joined = J.overlap_join(frame(left, "a"), frame(right, "b"), ["k"], ("a0", "a1"), ("b0", "b1"), fan=4, finest=finest)
    assert joined.columns == ["k", "a_id", "a0", "a1", "b_id", "b0", "b1"]
    got = [(r.a_id, r.b_id) for r in joined.collect()]
    expect = [
        (i, j)
        for i, k, a0, a1 in left
        for j, m, b0, b1 in right
        if k is not None and k == m and None not in (a1, b1) and a0 < a1 and b0 < b1 and a0 < b1 and b0 < a1
    ]
    assert sorted(got) == sorted(expect)
    points = frame(right, "b").select("b_id", "k", "b0")
    inside = J.overlap_join(frame(left, "a"), points, ["k"], ("a0", "a1"), ("b0", "b0"), fan=4, finest=finest)
    expect = [(i, j) for i, k, a0, a1 in left for j, m, b0, _ in right if k is not None and k == m and a1 is not None and a0 <= b0 < a1]
    assert sorted((r.a_id, r.b_id) for r in inside.collect()) == sorted(expect)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    assert J.overlap_join(frame([], "a"), frame(right, "b"), ["k"], ("a0", "a1"), ("b0", "b1")).collect() == []


# ---- store ------------------------------------------------------------------------


def month_rows(spark, month, value, tickers=3):
    days = [dt.date(2020 + month // 12, month % 12 + 1, d) for d in (1, 9, 28)]
    return spark.createDataFrame([(d, f"t{t}", float(value), t % 2) for d in days for t in range(tickers)], "date date, ticker string, x double, y int")


def test_a_range_opens_only_its_own_batches_and_months(spark, tmp_path):
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    assert store.batches() == [] and store.horizons().collect() == []
    with pytest.raises(FileNotFoundError):
        store.current()
    for month in range(50):
        store.upsert(month_rows(spark, month, month), ["x"], "y", 1 if month % 2 else 5)
    part = store.load_range(1, "2022-03-01", "2022-05-01")
    assert sorted({str(r.date)[:7] for r in part.collect()}) == ["2022-04"]
    opened = part.inputFiles()
    assert 0 < len(opened) <= 4 and all("month=2022-04-01" in f and "horizon=1" in f for f in opened)
    assert [r.horizon for r in store.horizons().collect()] == [1, 5]
    assert store.load_range(1, "2031-01-01").collect() == []
    before = sorted(store.current().collect())
    assert store.compact() and not store.compact()
    assert len(store.batches()) == 1 and sorted(store.current().collect()) == before
    part = store.load_range(1, "2022-03-01", "2022-05-01")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month", plan) and part.count() == 9
    assert store.vacuum() == 50 and sorted(store.current().collect()) == before


def test_a_reader_sees_one_state_while_batches_are_merged(spark, tmp_path, monkeypatch):
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    for value in range(3):
        store.upsert(month_rows(spark, 0, value), ["x"], "y", 1)
    reader, seen = store.current(), []
    real = files.write

    def spied(path, text):
        seen.append(sorted(r.vec[0] for r in FeatureStore(spark, store.path).current().collect()))
        if "replaces\": [\"t" in text:  # an upsert that commits between the merge and its manifest
            monkeypatch.setattr(files, "write", real)
            store.upsert(month_rows(spark, 0, 7, tickers=1), ["x"], "y", 1)
        real(path, text)

    monkeypatch.setattr(files, "write", spied)
    store.compact()
    assert seen == [[2.0] * 9] and [r.vec[0] for r in reader.collect()] == [2.0] * 9
    assert sorted(r.vec[0] for r in store.current().collect()) == [2.0] * 6 + [7.0] * 3
    store.vacuum()
    assert sorted(r.vec[0] for r in store.current().collect()) == [2.0] * 6 + [7.0] * 3


def test_a_batch_without_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    store.upsert(month_rows(spark, 0, 1), ["x"], "y", 1)

    def killed(path, text):
        raise KeyboardInterrupt

    monkeypatch.setattr(files, "write", killed)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(month_rows(spark, 0, 2), ["x"], "y", 1)
    monkeypatch.undo()
    assert {r.vec[0] for r in store.current().collect()} == {1.0}
    store.upsert(month_rows(spark, 0, 3).limit(0), ["x"], "y", 1)
    assert {r.vec[0] for r in store.current().collect()} == {1.0} and len(store.batches()) == 2


# ---- streams ----------------------------------------------------------------------


def test_streamed_bars_equal_batch_bars_and_late_rows_are_counted(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    inbox, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = low + (high - low) / 2
    late = []
    for lot in (events.filter(F.col("ts") < middle), events.filter(F.col("ts") >= middle)):
        lot.write.mode("append").parquet(inbox)
        late.append(B.write_available(B.windowed_bars(B.file_stream(spark, inbox, events.schema)), out, state))
    past = spark.createDataFrame([(low, "click", 5.0)], "ts timestamp, event_type string, value double")
    past.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(inbox)
    late.append(B.write_available(B.windowed_bars(B.file_stream(spark, inbox, events.schema)), out, state))
    assert late == [0, 0, 1]
    key = ["ticker", "ts"]
    got = spark.read.parquet(out).toPandas().sort_values(key).reset_index(drop=True)
    closed = high - dt.timedelta(hours=2)
    whole = intraday_bars(spark, "/root/testdata/sf0.001").toPandas()
    expect = whole[whole.ts + dt.timedelta(hours=1) <= closed].sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[expect.columns], expect, check_dtype=False)


def choice(ticker, signal, target=1.0):
    return (ticker, dt.date(2024, 1, 2), "5d", 10.0, target, signal, "model")


def test_a_replayed_ledger_batch_changes_nothing(spark, tmp_path):
    schema = "ticker string, date date, horizon string, p0 double, target double, signal string, source string"
    inbox, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    ledger = LedgerTable(spark, f"file://{tmp_path}/ledger")
    rows = lambda: sorted((r.ticker, r.signal, r.target) for r in ledger.read().collect())
    stored = lambda: sum(1 for _ in spark.read.parquet(ledger.path).toLocalIterator())

    def arrive(*choices):
        spark.createDataFrame(list(choices), schema).coalesce(1).write.mode("append").parquet(inbox)
        feed(B.file_stream(spark, inbox, schema), ledger, state)

    arrive(choice("A", "buy"), choice("A", "buy"), choice("B", "sell"))
    assert rows() == [("A", "buy", 1.0), ("B", "sell", 1.0)] and stored() == 2
    arrive(choice("B", "sell"), choice("A", "hold"))
    assert rows() == [("A", "hold", 1.0), ("B", "sell", 1.0)] and stored() == 3
    # The last batch is run again, as after a driver that died before it noted the commit.
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        file.unlink(missing_ok=True)
    feed(B.file_stream(spark, inbox, schema), ledger, state)
    assert rows() == [("A", "hold", 1.0), ("B", "sell", 1.0)] and stored() == 3
    ledger.append(spark.createDataFrame([choice("C", "buy")], schema), "t9-once")
    ledger.append(spark.createDataFrame([choice("C", "buy")], schema), "t9-once")
    assert stored() == 4 and D.LEDGER_COLUMNS.keys() == set(ledger.read().columns)
