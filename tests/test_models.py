import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bands as D
from barloom.operators import models as Z
from barloom.operators import perceptron as P
from barloom.operators.quantile_fit import fit_quantiles


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    n = 1500
    x, z = rng.normal(size=n), rng.uniform(-1, 1, n)
    y = 0.5 * x - 0.3 * z + (0.2 + 0.3 * np.abs(x)) * rng.standard_t(4, n)
    frame = pd.DataFrame({"x": x, "z": z, "flat": 3.0, "y": y, "part": np.arange(n) % 3})
    return frame, spark.createDataFrame(frame)


def loss(y, f, tau):
    d = y - f
    return np.maximum(tau * d, (tau - 1) * d).mean()


def test_quantile_fit_is_the_minimum_of_the_pinball_loss(noisy):
    frame, rows = noisy
    model = fit_quantiles(rows, ["x", "z", "flat"], "y", steps=120, smooth=1e-4)
    design = np.column_stack([np.ones(len(frame)), frame.x, frame.z, frame.flat])
    rng = np.random.default_rng(1)
    for (name, tau), w in zip(D.TAUS.items(), model.weights):
        assert w[3] == 0
        at = loss(frame.y, design @ w, tau)
        assert abs((frame.y < design @ w).mean() - tau) < 0.005
        tries = [loss(frame.y, design @ (w + rng.normal(scale=s, size=4) * [1, 1, 1, 0]), tau) for s in (0.01, 0.05, 0.3) for _ in range(60)]
        assert at <= min(tries) + 1e-4, name


def test_bands_are_ordered_null_safe_and_beat_empirical_ones(spark, noisy):
    frame, rows = noisy
    train, test = rows.filter("part < 2"), rows.filter("part = 2")
    train, test = (d.withColumn("size", F.abs("x")) for d in (train, test))
    model = fit_quantiles(train, ["x", "z", "size"], "y")
    out = model.bands(test.withColumn("x", F.when(F.col("z") > 0.9, None).otherwise(F.col("x")))).toPandas()
    assert out[out.z > 0.9].q50.isna().all()
    edges = out[out.z <= 0.9][list(D.TAUS)].to_numpy()
    assert (np.diff(edges, axis=1) >= 0).all()
    fitted = {r["level"]: r["pinball"] for r in model.loss(test, "y").collect()}
    bucket = F.floor(F.col("x")).cast("int")
    empirical = D.empirical_bands(train.withColumn("b", bucket), "y", ["b"])
    plain = test.withColumn("b", bucket).join(empirical, "b").toPandas()
    for name, tau in D.TAUS.items():
        assert fitted[name] <= loss(plain.y, plain[name], tau)


def test_quantile_fit_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([], "x double, y double")
    with pytest.raises(ValueError):
        fit_quantiles(empty, ["x"], "y")
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (None, 5.0)], "x double, y double")
    got = fit_quantiles(one, ["x"], "y").bands(one.limit(1)).first()
    assert [round(got[n], 3) for n in D.TAUS] == [2.0] * 5


def panel(spark, days=60, tickers=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d, date in enumerate(pd.bdate_range("2020-01-01", periods=days)):
        for t in range(tickers):
            a, b = rng.normal(size=2)
            up = int(a + 0.5 * b + rng.normal() > 0)
            rows.append((date.date(), t, float(a), float(b), None if t == 0 else float(up + rng.normal()), up, float(a + rng.normal())))
    return spark.createDataFrame(rows, "date date, ticker int, a double, b double, tone double, up int, fwd double")


def scores(frame):
    cols = [c for c in frame.columns if c.startswith("p_")]
    return frame.select("date", "ticker", "fold", *cols).toPandas().sort_values(["date", "ticker"]).reset_index(drop=True)


def test_out_of_fold_scores_every_date_without_itself(spark):
    rows = panel(spark).checkpoint()
    options = {"folds": 3, "purge": 2, "sentiment": ["tone"], "epochs": 15, "hidden": (4,)}
    first = scores(Z.out_of_fold(rows, ["a", "b"], "up", **options))
    assert len(first) == rows.count() and not first[["p_lr", "p_nb", "p_mlp", "p_sent"]].isna().any().any()
    dates = sorted(first.date.unique())
    assert first.groupby("date").fold.nunique().max() == 1 and first.fold.nunique() == 3
    # Other labels inside a block and the purged dates beside it leave the block's scores as they are.
    middle = first[first.fold == 1].date
    low, high = dates.index(middle.min()), dates.index(middle.max())
    touched = F.col("date").between(F.lit(dates[low - 2]), F.lit(dates[high + 2]))
    turned = rows.withColumn("up", F.when(touched, 1 - F.col("up")).otherwise(F.col("up"))).checkpoint()
    second = scores(Z.out_of_fold(turned, ["a", "b"], "up", **options))
    cols = ["p_lr", "p_nb", "p_mlp", "p_sent"]
    gaps = (first[cols] - second[cols]).abs()
    assert gaps[first.fold == 1].max().max() < 1e-4
    assert (gaps[first.fold != 1].max(axis=1) > 1e-3).mean() > 0.95


def test_stack_with_and_without_sentiment(spark):
    rows = panel(spark)
    train, test = rows.filter("date < '2020-03-01'"), rows.filter("date >= '2020-03-01'")
    out = Z.stacked(train, test, ["a", "b"], "up", epochs=10, hidden=(3,), folds=2, sentiment=["tone"])
    plain = Z.stacked(train, test, ["a", "b"], "up", epochs=10, hidden=(3,), folds=2)
    assert "p_sent" in out.columns and "p_sent" not in plain.columns
    auc = lambda d: Z.roc_auc(d, "up", "p").first()["auc"]
    assert auc(out) > auc(plain) > 0.6
    with pytest.raises(ValueError):
        Z.out_of_fold(train.limit(0), ["a", "b"], "up")


def test_walk_forward_takes_up_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = panel(spark, days=80)
    dates = [r[0] for r in rows.select("date").distinct().orderBy("date").collect()]
    roles = [(d, k, "train" if i < 40 + 10 * k else "test" if i < 50 + 10 * k else None) for k in range(3) for i, d in enumerate(dates)]
    roles = spark.createDataFrame([r for r in roles if r[2]], "date date, fold int, role string")
    config, store = {"family": "linear", "params": {"alpha": 0.01}}, f"file://{tmp_path}/run"
    run = lambda: Z.train_walk_forward(rows, ["a", "b"], "fwd", roles, config, "regression", store=store)
    fits, real = [], Z.fit_model

    def killed(*args):
        fits.append(1)
        if len(fits) == 2:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(Z, "fit_model", killed)
    with pytest.raises(KeyboardInterrupt):
        run()
    first = run().toPandas().sort_values("fold").reset_index(drop=True)
    assert len(fits) == 4 and first.fold.tolist() == [0, 1, 2]
    again = run().toPandas().sort_values("fold").reset_index(drop=True)
    assert len(fits) == 4 and again.equals(first)
    plain = Z.train_walk_forward(rows, ["a", "b"], "fwd", roles, config, "regression").toPandas()
    assert np.allclose(plain.sort_values("fold").rmse, first.rmse)
    kept = Z.FoldStore(spark, store)
    assert {(r["fold"], r["feature"]) for r in kept.importances().collect()} == {(k, f) for k in range(3) for f in "ab"}
    part = rows.filter(F.col("date") >= F.lit(dates[60])).filter(F.col("date") < F.lit(dates[70]))
    scored = kept.model(2).transform(part).toPandas()
    assert np.sqrt(((scored.prediction - scored.fwd) ** 2).mean()) == pytest.approx(first.rmse[2])
    with pytest.raises(ValueError):
        Z.train_walk_forward(rows, ["a"], "fwd", roles, config, "regression", store=store)


def test_checkpoint_keeps_its_scaler(spark, tmp_path):
    rows = panel(spark).withColumn("b", F.col("b") * 1000 + 50)
    scaler = Z.ColumnScaler.fitted(rows, ["a", "b"])
    scaled = scaler.transform(rows)
    model = Z.balanced_logistic(scaled, scaler.outputs(), "up")
    before = Z.probability(model.transform(Z.assembled(scaled, scaler.outputs()))).select("date", "ticker", "p").toPandas()
    Z.save_checkpoint(["a", "b"], model, f"file://{tmp_path}/model", scaler)
    loaded = Z.load_checkpoint(f"file://{tmp_path}/model")
    assert loaded.stages[0].getInputCols() == ["a", "b"]
    after = Z.probability(loaded.transform(rows)).select("date", "ticker", "p").toPandas()
    both = before.merge(after, on=["date", "ticker"])
    assert len(both) == len(before) and np.allclose(both.p_x, both.p_y, atol=1e-12)


def test_balanced_logistic_equals_weighted_newton(spark):
    rows = panel(spark).filter("up = 1 or ticker < 4")
    frame = rows.toPandas()
    model = Z.balanced_logistic(rows, ["a", "b"], "up", 0.1)
    x, y = np.column_stack([np.ones(len(frame)), frame.a, frame.b]), frame.up.to_numpy()
    k = len(y) / (2 * np.where(y == 1, y.sum(), (1 - y).sum()))
    w, penalty = np.zeros(3), np.diag([0, 10.0, 10.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (k * (p - y)) + penalty @ w)
    assert np.allclose([model.intercept, *model.coefficients], w, atol=1e-5)


def test_perceptron_reaches_the_loss_of_sparks_optimizer_in_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW_ROWS", 10)
    monkeypatch.setattr(P, "FILE_ROWS", 150)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=700) > 0).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    config = {"family": "mlp", "params": {"layers": [3, 6, 4, 2], "epochs": 40}}
    model = Z.fit_model(config, "classification", rows, list("abc"), "y")
    assert isinstance(Z.build_model(config, "classification", "y"), P.BlockPerceptron)
    loss = lambda w: P.loss_and_gradient(w, [3, 6, 4, 2], x, y)[0] / 700
    w = model.weights.toArray()
    monkeypatch.setattr(P, "FEW_ROWS", 1 << 40)
    plain = Z.fit_model(config, "classification", rows, list("abc"), "y").weights.toArray()
    assert loss(w) < loss(plain) + 0.02 < 0.35
    # The gradient is that of the loss, and the model scores by these weights.
    step, k = 1e-6, 11
    moved = w + step * (np.arange(len(w)) == k)
    assert abs((loss(moved) - loss(w)) / step - P.loss_and_gradient(w, [3, 6, 4, 2], x, y)[1][k] / 700) < 1e-5
    p = Z.probability(model.transform(Z.assembled(rows, list("abc")))).select("p", "y").toPandas()
    assert abs(-np.log(np.where(p.y == 1, p.p, 1 - p.p)).mean() - loss(w)) < 1e-9
    monkeypatch.setattr(P, "FEW_ROWS", 0)
    with pytest.raises(Exception, match="missing or out of range"):
        Z.fit_model(config, "classification", rows.withColumn("y", F.col("y") + 2), list("abc"), "y")
