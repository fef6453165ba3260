"""Cleaning, labels, splits, metrics, bands, selection, sources."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bands as D
from barloom.operators import bootstrap
from barloom.operators import cleaning as C
from barloom.operators import context as X
from barloom.operators import infotheory as I
from barloom.operators import labels as L
from barloom.operators import metrics as M
from barloom.operators import models as Z
from barloom.operators import ranking
from barloom.operators import sequences as Q
from barloom.operators import splits as S
from barloom.operators import technicals as T
from barloom.sources import bars as B
from barloom.sources import news as N
from barloom.sources.store import FeatureStore, LedgerTable


def series(spark, values, kind="double"):
    rows = [("A", i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"ticker string, i int, a {kind}")
    return df.select("ticker", F.date_add(F.lit("2020-01-01").cast("date"), "i").alias("date"), "a")


def test_forward_fill_limit(spark):
    out = C.forward_fill(series(spark, [1.0, None, None, None, 5.0]), ["a"], 1).orderBy("date").toPandas().a
    assert out.isna().tolist() == [False, False, True, True, False]


def test_zero_volume_and_impute(spark):
    df = series(spark, [0.0, 100.0, 0.0]).withColumnRenamed("a", "volume")
    assert C.drop_zero_volume(df).count() == 1
    assert C.median_impute(series(spark, [1.0, None, 3.0, None]), ["a"]).toPandas().a.tolist().count(2.0) == 2


def test_winsorize(spark):
    rng = np.random.default_rng(0)
    x = [5.0, -5.0, *rng.normal(0, 0.01, 998)]
    out = C.winsorize(series(spark, [float(v) for v in x]), "a", 0.005, 0.995).toPandas().a
    s = pd.Series(x)
    assert out.max() == pytest.approx(s.quantile(0.995)) and out.min() == pytest.approx(s.quantile(0.005))


def test_subsample_is_exact_and_stable(panel):
    a = C.subsample(panel, 100, ["ticker", "date"])
    assert a.count() == 100
    assert a.exceptAll(C.subsample(panel.repartition(7), 100, ["ticker", "date"])).count() == 0


def test_direction_label(panel):
    p = L.direction(panel, 1).toPandas().sort_values(["ticker", "date"])
    one = p[p.ticker == "AAA"]
    assert np.isnan(one.y_binary_h1.iloc[-1])
    assert (one.y_binary_h1.iloc[:-1].to_numpy() == (one.close.shift(-1) > one.close).iloc[:-1].astype(int)).all()


def test_count_labels_with_ties_and_nulls(spark):
    rows = [("2020-01-01", f"t{i}", v) for i, v in enumerate([1.0, 1.0, 2.0, 3.0, None, 4.0, 4.0, 5.0, 6.0, 7.0])]
    df = spark.createDataFrame(rows, "date string, ticker string, f double").withColumn("date", F.to_date("date"))
    out = L.top_bottom_by_count(df, "f").toPandas().set_index("ticker").y_cs_quantile
    # ten names: three each; one return is missing, so ranks end at nine
    assert out["t0"] == 0 and out["t2"] == 0 and out["t9"] == 1 and out["t8"] == 1 and np.isnan(out["t7"])


def test_folds_and_purge(spark):
    dates = pd.bdate_range("2010-01-01", "2024-12-31")
    df = spark.createDataFrame(pd.DataFrame({"date": dates.date, "ticker": "A"}))
    folds = S.walk_forward_folds(df).orderBy("fold").toPandas()
    assert len(folds) >= 2
    assert (folds.train_end <= folds.val_start).all() and (folds.val_end <= folds.test_start).all()
    assert (folds.test_end.iloc[:-1].to_numpy() <= folds.test_start.iloc[1:].to_numpy()).all()
    roles = S.walk_forward_roles(df, S.walk_forward_folds(df)).toPandas().merge(folds, on="fold")
    train = roles[roles.role == "train"]
    gap = (pd.to_datetime(train.test_start) - pd.to_datetime(train.date)).dt.days
    assert (gap > 20).all()


def test_leap_day_start(spark):
    df = spark.createDataFrame([("2016-02-29",), ("2026-01-01",)], "date string").withColumn("date", F.to_date("date"))
    first = S.walk_forward_folds(df, 4, 1, 1, 1).orderBy("fold").first()
    assert str(first.train_end) == "2020-02-28"


def test_cpcv_purges_every_test_block(spark):
    df = spark.createDataFrame([(i,) for i in range(120)], "i int").select(
        F.date_add(F.lit("2020-01-01").cast("date"), "i").alias("date")
    )
    roles = S.cpcv_paths(df, purge=3, embargo_frac=0.02).toPandas()
    assert roles.path.nunique() == 15
    for _, g in roles.groupby("path"):
        test = pd.to_datetime(g[g.role == "test"].date)
        train = pd.to_datetime(g[g.role == "train"].date)
        assert not set(test) & set(train)
        days = np.subtract.outer(train.to_numpy(), test.to_numpy()) / np.timedelta64(1, "D")
        assert not ((days < 0) & (days >= -3)).any() and not ((days > 0) & (days <= 2)).any()


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 7
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert M.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)
    weighted = df.withColumn("w", F.lit(2.0))
    assert M.roc_auc(weighted, "y", "s", weight="w").first()[0] == pytest.approx(want)
    assert M.roc_auc(df.filter("y = 1"), "y", "s").first()[0] is None


def test_simple_metrics(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(100)], "y double, p double")
    assert M.information_coefficient(df, "y", "p").first()[0] > 0.99
    same = df.withColumn("p", F.col("y"))
    assert same.agg(M.pinball(F.col("y"), F.col("p"), 0.5)).first()[0] == 0
    assert same.agg(M.brier(F.col("y"), F.col("p"))).first()[0] == 0
    d = spark.createDataFrame([(0.01, 0.5), (-0.02, -0.5), (0.03, 0.5), (-0.04, -0.5), (0.0, 1.0)], "y double, p double")
    assert d.agg(M.directional_accuracy(F.col("y"), F.col("p"))).first()[0] == 1.0


@pytest.mark.parametrize("held", [16_384, 20])
def test_bootstrap_gap_equals_weighted_aucs(spark, monkeypatch, held):
    """Scores with ties, ranges of any size: each replicate is the AUC of rows repeated by their weights."""
    monkeypatch.setattr(ranking, "RANGE_VALUES", held)
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    a = np.where(rng.random(400) < 0.4, 0.5, y + rng.normal(0, 0.5, 400))
    p = pd.DataFrame({"i": range(400), "y": y, "a": a, "b": rng.normal(size=400)})
    row = bootstrap.bootstrap_auc_gap(spark.createDataFrame(p), "y", "a", "b", ["i"], 100).first()
    assert row.lo < row.gap < row.hi and row.lo > 0 and row.p_value < 0.05
    h = np.array([bootstrap._number(str(i)) % bootstrap.PRIME for i in p.i])
    gaps, weights = [], []
    for r in range(100):
        u = [(int(x) * (bootstrap._number(f"0:{r}:a") % (bootstrap.PRIME - 1) + 1) + bootstrap._number(f"0:{r}:b")) % bootstrap.PRIME for x in h]
        w = np.array([sum(x / bootstrap.PRIME >= t for t in bootstrap.poisson_steps()) for x in u], dtype=float)
        up, down = w * y, w * (1 - y)
        auc = lambda s: (np.outer(up, down) * ((s[:, None] > s) + (s[:, None] == s) / 2)).sum() / up.sum() / down.sum()  # noqa: E731, B023
        gaps.append(auc(a) - auc(p.b.values))
        weights.append(w)
    assert (row.lo, row.hi) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])))
    assert abs(np.mean(weights) - 1) < 0.02 and abs(np.var(weights) - 1) < 0.05
    again = bootstrap.bootstrap_auc_gap(spark.createDataFrame(p).repartition(5), "y", "a", "b", ["i"], 100).first()
    assert again == row


@pytest.mark.parametrize("held", [16_384, 50])
def test_ranks_of_hot_groups_ties_and_slivers(spark, monkeypatch, held):
    """One group holds most rows, one value a third of them, and a third lie within 1e-13 of each other."""
    monkeypatch.setattr(ranking, "RANGE_VALUES", held)
    monkeypatch.setattr(ranking, "SAMPLED", 400)
    rng = np.random.default_rng(0)
    n = 6000
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n)).astype(object)
    g[:300] = None
    x = rng.normal(size=n)
    x[rng.random(n) < 0.3] = 0.5
    sliver = rng.random(n) < 0.3
    x[sliver] = 1 + rng.random(sliver.sum()) * 1e-13
    x[rng.random(n) < 0.05] = np.nan
    p = pd.DataFrame({"i": range(n), "g": g, "x": x, "y": rng.integers(0, 5, n).astype(float)})
    df = spark.createDataFrame(p).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = ranking.with_ranks(df, ["g"], {"rx": "x", "ry": "y"}).toPandas().sort_values("i")
    p["k"] = p.g.fillna("~")
    for c in "xy":
        np.testing.assert_allclose(got["r" + c].to_numpy(float), p.groupby("k")[c].rank(pct=True).to_numpy())
    values = ranking.value_ranks(df, ["g"], "x").toPandas()
    assert len(values) == p.dropna(subset="x").groupby("k").x.nunique().sum()
    hot, at = np.sort(p[p.k == "hot"].x.dropna().to_numpy()), values[values.g == "hot"]
    assert (np.searchsorted(hot, at.x) == at.below).all() and (at.total == len(hot)).all()
    assert (np.searchsorted(hot, at.x, side="right") == at.below + at.n).all()
    assert ranking.value_ranks(df, [], "x").first().total == p.x.notna().sum()
    if held == 50:  # the sliver alone asks for many ranges
        parts = ranking.ranged_values(df.filter("g = 'hot' and x > 1 and x < 1.1"), ["g"], "x", "i", F.lit(1))
        assert parts.groupBy("__part").count().agg(F.max("count")).first()[0] < 400
    assert ranking.with_ranks(df.limit(0), ["g"], {"rx": "x"}).count() == 0


def test_conformal_delta(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=99)
    df = spark.createDataFrame(pd.DataFrame({"h": 1, "y": y, "q05": -0.5, "q95": 0.5}))
    got = D.conformal_delta(df, "y", ["h"]).first().delta
    s = np.sort(np.maximum(-0.5 - y, y - 0.5))
    assert got == pytest.approx(max(s[int(np.ceil(0.9 * 100)) - 1], 0))


def test_ledger_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", "1d", 10.0, 11.0, 9.0, 12.0, 10.5)], "ticker string, horizon string, p0 double, target double, range_lo double, range_hi double, actual double")
    rows = rows.withColumns({"date": F.lit("2024-01-02").cast("date"), "signal": F.lit("hold")})
    table = LedgerTable(spark, str(tmp_path / "ledger"))
    table.append(D.manual_choices(rows))
    table.append(D.manual_choices(rows.withColumn("target", F.lit(10.5))))
    got = table.read().toPandas()
    assert len(got) == 1 and got.error[0] == 0 and bool(got.in_band[0])
    assert D.per_ticker_delta(table.read()).first().delta == 0


def test_store_keeps_newest(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("A", 1.0, 1), ("B", 2.0, None)], "ticker string, x double, y int")
    df = df.withColumn("date", F.lit("2024-01-02").cast("date"))
    store.upsert(df, ["x"], "y", 5)
    store.upsert(df.filter("ticker = 'A'").withColumn("x", F.lit(9.0)), ["x"], "y", 5)
    assert store.load_all(5).first().vec == [9.0]
    assert store.load_range(5, label_only=False).count() == 2
    assert store.load_range(5, start="2024-02-01").count() == 0
    assert store.summary().first().rows == 1


def test_read_bar_files(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Volume,OpenInt\n"
    (tmp_path / "aaa.us.txt").write_text(head + "2020-01-02,1,2,0.5,1.5,100,0\n2020-01-02,1,2,0.5,1.6,100,0\n")
    (tmp_path / "aaa.csv").write_text(head + "2020-01-03,9,9,9,9,9,0\n")
    (tmp_path / "bbb.csv").write_text(head + "2020-01-03,3,3,3,3,7,0\n")
    root = str(tmp_path)
    assert [r.ticker for r in B.list_available(spark, root).collect()] == ["AAA", "BBB"]
    got = B.read_bars(spark, root).toPandas().set_index("ticker")
    assert len(got) == 2 and got.close["AAA"] == 1.6 and got.volume["BBB"] == 7
    with pytest.raises(FileNotFoundError):
        B.read_ticker(spark, root, "zzz")
    with pytest.raises(ValueError):
        B.normalize_columns(spark.createDataFrame([(1,)], "Close int"))


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "AAA.us.txt").write_text("Date,Open,High,Low,Close,Volume,OpenInt\n2020-01-02,1,4,0.5,2,10,0\n")
    (tmp_path / "BBB.CSV").write_text('"Date","Close","Open",High,Low,Volume\n"2020-01-02",11.5,11,12,10.5,"7"\n')
    got = {r.ticker: (r.open, r.high, r.low, r.close, r.volume) for r in B.read_bars(spark, str(tmp_path)).collect()}
    assert got == {"AAA": (1, 4, 0.5, 2, 10), "BBB": (11, 12, 10.5, 11.5, 7)}
    (tmp_path / "ccc.csv").write_text("Date,Open,High,Low,Close\n2020-01-02,1,1,1,1\n")
    with pytest.raises(ValueError, match="volume"):
        B.read_bars(spark, str(tmp_path))


def test_wide_long_round_trip(spark, panel):
    wide = B.to_wide(panel, "close", ["AAA", "BBB"])
    long = B.to_long(wide, "close").dropna()
    assert long.count() == panel.filter("ticker <> 'CCC'").count()


def test_news(spark):
    rows = [
        ("A", '{"pubDate": "2024-01-02T10:00:00Z", "title": "good good"}'),
        ("A", '{"content": {"providerPublishTime": 1704153600, "headline": "bad"}}'),
        ("A", '{"title": "no time"}'),
        ("A", '{"pubDate": "2024-01-02T10:00:00Z", "title": ""}'),
    ]
    flat = N.flatten_news(spark.createDataFrame(rows, "ticker string, j string"), "j")
    assert sorted((str(r.date), r.title) for r in flat.collect()) == [("2024-01-02", "bad"), ("2024-01-02", "good good")]
    lex = spark.createDataFrame([("good", 2.0), ("bad", -1.0)], "word string, valence double")
    got = {r.title: r.score for r in N.lexicon_scores(flat, "title", lex, ("title",)).collect()}
    assert got["good good"] == pytest.approx(4 / np.sqrt(31)) and got["bad"] == pytest.approx(-1 / 4)


def test_pair_correlation_and_clusters(spark, panel, pdf):
    ret = panel.withColumn("r", T.DAILY.log_return(F.col("close")))
    got = X.pair_correlation(ret, "r").toPandas().set_index(["a", "b"]).rho
    wide = pdf.pivot(index="date", columns="ticker", values="close")
    want = np.log(wide / wide.shift(1)).corr()
    for (a, b), rho in got.items():
        assert rho == pytest.approx(want.loc[a, b], abs=1e-9)
    few = X.correlation_clusters(panel, panel.select("ticker").distinct()).toPandas()
    assert (few.cluster == "MARKET").all()


def test_pair_correlation_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(X, "TILE", 4)
    rng = np.random.default_rng(4)
    p = pd.DataFrame(rng.normal(size=(40, 11)), columns=range(11), index=pd.date_range("2020-01-01", periods=40).date)
    p = p.mask(rng.random(p.shape) < 0.1)
    long = p.rename_axis("date").reset_index().melt("date", var_name="ticker", value_name="x").dropna()
    long["ticker"] = long.ticker.astype(int)
    got = X.pair_correlation(spark.createDataFrame(long), "x").toPandas()
    want = p.corr()
    assert len(got) == 55 and (got.a < got.b).all()
    np.testing.assert_allclose(got.rho, [want.loc[a, b] for a, b in zip(got.a, got.b)], atol=1e-9)


def test_information(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    p = pd.DataFrame({"a": y + rng.normal(0, 0.3, 2000), "b": rng.normal(size=2000), "k": 1.0, "y": y})
    df = spark.createDataFrame(p)
    mi = {r.feature: r.mi for r in I.mutual_information(df, ["a", "b", "k"], "y").collect()}
    for c in ("a", "b"):
        n, _, _ = np.histogram2d(p[c], p.y.astype(float), bins=20)
        q = n / n.sum()
        h = lambda v: -np.sum(v[v > 0] * np.log2(v[v > 0]))
        assert mi[c] == pytest.approx(h(q.sum(1)) + h(q.sum(0)) - h(q.ravel()), abs=1e-9)
    assert mi["k"] == 0
    assert [r.feature for r in I.top_by_information(df, ["a", "b"], "y", 1).collect()] == ["a"]


def test_prune_and_scree(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    p = pd.DataFrame({"a": a, "b": a + rng.normal(0, 1e-3, 500), "c": rng.normal(size=500)})
    df = spark.createDataFrame(p)
    left = I.prune_correlated(df, ["a", "b", "c"])
    assert len(left) == 2 and "c" in left
    shares = I.pca_scree(df, ["a", "b", "c"]).toPandas().explained
    ev = np.sort(np.linalg.eigvalsh(p.corr()))[::-1]
    np.testing.assert_allclose(shares, ev / ev.sum(), rtol=1e-6)


@pytest.mark.parametrize("w,t", [(30, 20), (180, 20), (5, 20), (1, 1)])
def test_sample_offsets(spark, w, t):
    n = 200
    df = series(spark, [float(i) for i in range(n)])
    got = Q.multiscale_sequences(df, ["a"], (w,), t).orderBy(F.desc("date")).first()[f"seq{w}"]
    seg = np.arange(n)[-w:]
    want = seg if len(seg) <= t else seg[np.linspace(0, w - 1, t).round().astype(int)]
    assert [v[0] for v in got] == [float(x) for x in want]


def test_lookback_excludes_current_row(spark):
    out = Q.lookback_sequences(series(spark, [0.0, 1.0, 2.0, 3.0]), ["a"], 2).orderBy("date").collect()
    assert [[v[0] for v in r.seq] for r in out] == [[0.0, 1.0], [1.0, 2.0]]


def test_blend_and_naive_bayes(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    p = pd.DataFrame({"y": y, "a": y * 0.5 + rng.random(500), "b": rng.random(500), "x": y + rng.normal(size=500)})
    df = spark.createDataFrame(p)
    row = Z.fit_blend(df, "y", "a", "b").first()
    assert row.a >= 0.5 and row.auc >= M.roc_auc(df, "y", "a").first()[0] - 1e-9
    got = Z.bayes_probability(df, Z.bayes_table(df, ["x"], "y"), ["x"], "y").toPandas()
    dens = [np.log((y == k).mean()) - 0.5 * (np.log(2 * np.pi * (v := p.x[y == k].var(ddof=0) + 1e-9)) + (p.x - p.x[y == k].mean()) ** 2 / v) for k in (0, 1)]
    np.testing.assert_allclose(got.sort_values("x").p, (1 / (1 + np.exp(dens[0] - dens[1])))[p.x.argsort()], rtol=1e-9)


def test_end_to_end_walk_forward(spark, panel):
    df = L.forward_returns(T.rate_of_change(panel.filter("ticker <> 'CCC'"), (5, 10)), (5,))
    roles = S.block_folds(df, 2, 5, 50, 10)
    out = Z.train_walk_forward(df, ["roc_5", "roc_10"], "y_logret_h5", roles, {"family": "linear", "params": {"alpha": 0.01}}, "regression")
    assert out.count() >= 1 and {"rmse", "ic", "n_train"} <= set(out.columns)
