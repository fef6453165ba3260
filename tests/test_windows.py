"""Smoothing, rolling windows, ranks and blocks against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.ewm import Ewm, with_ewm
from barloom.functions.expr import DAILY, Axis
from barloom.functions.rolling import Roll, with_rolling
from barloom.operators import blocks, ranking
from barloom.operators import extended as X
from barloom.operators import technicals as T


def aligned(df, names):
    out = df.select("ticker", "date", *names).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    return out


def per_ticker(pdf, fn):
    return pd.concat([fn(g) for _, g in pdf.sort_values(["ticker", "date"]).groupby("ticker")]).to_numpy(dtype=float)


@pytest.mark.parametrize("span,warm", [(3, 0), (9, 9), (26, 26), (200, 200), (1, 0)])
def test_ewm_matches_pandas(panel, pdf, span, warm):
    got = aligned(with_ewm(panel, DAILY, {"y": Ewm.span("close", span, warm)}), ["y"]).y.to_numpy(dtype=float)
    want = per_ticker(pdf, lambda g: g.close.ewm(span=span, adjust=False, min_periods=warm).mean())
    np.testing.assert_allclose(got, want, rtol=1e-10, equal_nan=True)


def test_ewm_adjusted_with_gaps(spark):
    x = [None, 1.0, None, 3.0, 4.0, None, None, 2.0]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "ticker string, t int, x double")
    out = with_ewm(df, Axis(("ticker",), "t"), {"y": Ewm.span("x", 5, 1, adjust=True)}).orderBy("t").toPandas().y
    want = pd.Series(x, dtype=float).ewm(span=5, min_periods=1).mean()
    np.testing.assert_allclose(out.to_numpy(dtype=float), want.to_numpy(), rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("share", [0.0, 0.1, 0.6, 0.95])
def test_ewm_over_gaps_matches_pandas(spark, share, adjust):
    rng = np.random.default_rng(int(share * 100))
    x = rng.normal(100, 5, 700)
    x[rng.random(700) < share] = np.nan
    x[:5] = x[300:560] = x[-3:] = np.nan
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "ticker string, t int, x double")
    specs = {f"y{n}_{warm}": Ewm.span("x", n, warm, adjust) for n in (1, 2, 9, 200) for warm in (0, 4)}
    got = with_ewm(df, Axis(("ticker",), "t"), specs).orderBy("t").toPandas()
    for name, spec in specs.items():
        want = pd.Series(x).ewm(alpha=spec.alpha, adjust=adjust, min_periods=spec.min_periods).mean()
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), want.to_numpy(), rtol=1e-9)


def test_ewm_crosses_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(100, 5, 3000)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "t": range(3000), "x": x}))
    got = with_ewm(df, Axis(("ticker",), "t"), {"a": Ewm.span("x", 3), "b": Ewm.span("x", 9)}).orderBy("t").toPandas()
    for name, span in (("a", 3), ("b", 9)):
        want = pd.Series(x).ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(got[name], want, rtol=1e-10)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 17, 60, 252])
def test_rolling_matches_pandas(panel, pdf, n):
    specs = {k: Roll(k, "close", n) for k in ("avg", "sum", "std", "std_pop", "max", "min")}
    if n == 1:
        specs.pop("std")
    got = aligned(with_rolling(panel, DAILY, specs), list(specs))
    for kind in specs:
        roll = {"avg": "mean", "std": "std", "std_pop": "std"}.get(kind, kind)
        kw = {"ddof": 0} if kind == "std_pop" else {}
        want = per_ticker(pdf, lambda g: getattr(g.close.rolling(n, min_periods=n), roll)(**kw))
        np.testing.assert_allclose(got[kind].to_numpy(dtype=float), want, rtol=1e-9, atol=1e-9, equal_nan=True)


def test_rolling_constant_series_has_zero_deviation(spark):
    df = spark.createDataFrame([("A", i, 0.1) for i in range(50)], "ticker string, t int, x double")
    out = with_rolling(df, Axis(("ticker",), "t"), {"s": Roll("std", "x", 20)}).filter("s is not null").toPandas()
    assert len(out) == 31 and (out.s.abs() < 1e-15).all()


@pytest.fixture(scope="module")
def ties(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(i), None if rng.random() < 0.1 else float(rng.integers(-5, 6)) / 4) for g in "ab" for i in range(200)]
    return spark.createDataFrame([*rows, ("c", 0, 1.5)], "g string, i int, x double").cache()


def test_values_crowded_into_a_tiny_interval_use_many_tasks(spark):
    df = spark.range(200_000).select((10_000 + F.col("id") * 5e-7).alias("x"))
    ranks = ranking.value_ranks(df, [], "x")
    got = ranks.agg(F.count("*"), F.sum((F.col("below") == F.round((F.col("x") - 10_000) / 5e-7)).cast("int"))).first()
    assert tuple(got) == (200_000, 200_000)
    # Without merging of small partitions, the ranges of the one bucket are spread.
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        parts = ranking.value_ranks(df, [], "x").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(merged, "true")
    assert parts > 1


def test_ranks(ties):
    got = ranking.with_ranks(ties, ["g"], {"p": "x"}).toPandas().sort_values(["g", "i"])
    want = got.groupby("g").x.rank(pct=True)
    np.testing.assert_allclose(got.p.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)
    two = ties.withColumn("z", -F.col("x") * F.col("i"))
    got = ranking.with_ranks(two, ["g"], {"p": "x", "q": "z"}).toPandas().sort_values(["g", "i"])
    assert len(got) == 401
    for out, x in (("p", "x"), ("q", "z")):
        want = got.groupby("g")[x].rank(pct=True)
        np.testing.assert_allclose(got[out].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


def test_quantiles_and_kth(ties):
    p = ties.toPandas()
    q = ranking.quantiles(ties, ["g"], "x", {"a": 0.05, "b": 0.5, "c": 0.8}).toPandas().set_index("g")
    want = p.groupby("g").x.quantile([0.05, 0.5, 0.8]).unstack()
    np.testing.assert_allclose(q.loc[want.index, ["a", "b", "c"]], want)
    k = ranking.kth_smallest(ties, ["g"], "x", F.lit(7), "k").toPandas().set_index("g").k
    assert k["a"] == p[p.g == "a"].x.dropna().sort_values().iloc[6]


def test_ordinal_rank_is_a_permutation(ties):
    got = ranking.with_ordinal(ties, ["g"], "x", ["i"], "r").toPandas()
    for _, g in got.groupby("g"):
        s = g.sort_values(["x", "i"]).r.tolist()
        assert s == list(range(1, len(g) + 1))


def test_order_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 10.0 ** rng.integers(-9, 9, 3000)), [0.0, -0.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": np.sort(x)}))
    b = df.select("x", ranking.order_bucket(F.col("x")).alias("b")).toPandas().sort_values("x").b
    assert b.is_monotonic_increasing


def test_blocked_windows_equal_plain(spark):
    n = 9000
    rng = np.random.default_rng(2)
    p = pd.DataFrame(
        {
            "ticker": rng.choice(["A", "B"], n, p=[0.95, 0.05]),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="min"),
            "x": rng.normal(size=n),
        }
    )
    df = spark.createDataFrame(p)
    ax = Axis(("ticker",), "ts")
    cut, bx = blocks.blocked(df, ax, back=30, ahead=5)
    assert cut.agg(F.max(blocks.BLOCK)).first()[0] >= 2
    got = blocks.owned(
        cut.withColumns({"m": bx.full(F.avg, F.col("x"), 30), "l": bx.lead(F.col("x"), 5), "d": bx.lag(F.col("x"), 30)})
    )
    want = df.withColumns({"m": ax.full(F.avg, F.col("x"), 30), "l": ax.lead(F.col("x"), 5), "d": ax.lag(F.col("x"), 30)})
    a = got.toPandas().sort_values("ts").reset_index(drop=True)
    b = want.toPandas().sort_values("ts").reset_index(drop=True)
    assert len(a) == n
    for c in ("m", "l", "d"):
        np.testing.assert_allclose(a[c].to_numpy(dtype=float), b[c].to_numpy(dtype=float), rtol=1e-9, atol=1e-12, equal_nan=True)
    total = blocks.running_sum(df, ax, "x", "s").toPandas().sort_values("ts")
    np.testing.assert_allclose(total.s, p.groupby("ticker").x.cumsum(), atol=1e-9)


INDICATORS = {
    "returns": lambda d: T.log_returns(d),
    "ema": lambda d: T.ema(d, [9, 21]),
    "macd": T.macd,
    "rsi": T.rsi,
    "vol": T.realized_volatility,
    "atr": T.atr,
    "bollinger": T.bollinger,
    "roc": lambda d: T.rate_of_change(d, [5, 10]),
    "highlow": lambda d: T.rolling_high_low(d, [20, 60]),
    "range": T.close_in_range,
    "extended": X.extended_features,
    "modular": lambda d: T.modular_features(d, min_history=1),
}


@pytest.mark.parametrize("name", INDICATORS)
def test_no_look_ahead(panel, pdf, spark, name):
    """Dropping the last 50 rows of each ticker leaves earlier values alone."""
    fn = INDICATORS[name]
    cut = pdf[pdf.groupby("ticker").cumcount(ascending=False) >= 50]
    names = [c for c in fn(panel).columns if c not in panel.columns]
    whole = aligned(fn(panel), names).set_index(["ticker", "date"])
    part = aligned(fn(spark.createDataFrame(cut)), names).set_index(["ticker", "date"])
    np.testing.assert_allclose(
        part.to_numpy(dtype=float), whole.loc[part.index].to_numpy(dtype=float), rtol=1e-8, atol=1e-9, equal_nan=True
    )


def test_ranges(panel):
    df = T.close_in_range(T.rolling_high_low(T.atr(T.realized_volatility(T.rsi(panel))), [20]))
    p = df.toPandas()
    assert p.rsi_14.dropna().between(0, 100).all()
    assert (p.realized_vol_20.dropna() >= 0).all() and (p.atr_14.dropna() >= 0).all()
    assert (p.dist_to_high_20.dropna() <= 0).all() and (p.dist_to_low_20.dropna() >= 0).all()
    assert p.close_in_range_20.dropna().between(0, 1).all()


def test_zero_price_and_flat_series(spark):
    rows = [("Z", f"2020-01-{i + 1:02d}", 0.0 if i == 5 else 10.0, 0.0) for i in range(25)]
    df = spark.createDataFrame(rows, "ticker string, date string, close double, volume double")
    df = df.select("ticker", F.to_date("date").alias("date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume")
    out = T.rsi(T.bollinger(T.close_in_range(T.log_returns(df)))).toPandas()
    assert len(out) == 25
    assert np.isinf(out.select_dtypes("number").to_numpy(dtype=float)).sum() == 0
