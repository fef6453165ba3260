"""Registered queries: models.

Closed forms and logistic fits (Newton steps) are checked with SQL on one feature; other
iterative fits are rows-only.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import intraday as N
from barloom.operators import models as Z
from barloom.operators import splits as S
from barloom.operators import technicals as T
from barloom.operators import labels as L
from barloom.operators.bands import TAUS
from barloom.operators.blocks import date_positions
from barloom.operators.quantile_fit import fit_quantiles
from barloom.plans.q_panels import FEATS, PROBE, probe_frame
from barloom.plans.q_sources import LEXICON
from barloom.plans.registry import query, rounded
from barloom.plans.sqltext import WIDE
from barloom.session import materialize, scratch_path
from barloom.sources.datasets import daily_panel, table, wide_panel
from barloom.sources.news import lexicon_scores, sentiment_panel

KEY = ["ticker", "date"]
FEW = ["ret5", "ret20", "vol20", "rsi14", "dist_hi", "dist_lo"]


def _holdout(df, fraction=0.7, purge=1):
    """Roles per date, written: a table known to be small spares the rows a shuffle at every read."""
    return materialize(S.purged_holdout(df, fraction, purge), "roles")


def _split(spark, sf_dir, columns):
    df = probe_frame(spark, sf_dir, columns)
    data = S.with_roles(df, _holdout(df))
    return data.filter("role = 'train'"), data.filter("role = 'test'")


def _early_late(train):
    """The last fifth of the training dates, which stops boosting early, and those before it less one."""
    df = train.drop("role")
    parts = S.with_roles(df, _holdout(df, 0.8))
    return parts.filter("role = 'train'"), parts.filter("role = 'test'")


def _coef(model, features, df):
    return rounded(Z.coefficients(model, features, df), ["feature"])


ONE = ["dist_hi"]


def _logistic_sql(alpha: str, select: str, balanced: bool = False, scaled: bool = False) -> str:
    """Newton steps for a logistic fit of ``up`` on one feature with a free intercept, on the training dates."""
    weight = "(SELECT count(*) FROM t0) / (2 * (count(*) OVER (PARTITION BY y)))" if balanced else "1"
    mean, spread = ("(SELECT avg(x) FROM t0)", "((SELECT stddev_pop(x) FROM t0) + 1e-9)") if scaled else ("0", "1")
    return f"""WITH RECURSIVE {WIDE}, {PROBE},
 q AS MATERIALIZED (SELECT ticker, date, dist_hi AS x, CAST(fwd > 0 AS INTEGER) AS y, dense_rank() OVER (ORDER BY date) - 1 AS p FROM pb),
 e AS (SELECT floor(0.7::DOUBLE * (max(p) + 1)) AS cut FROM q), t0 AS MATERIALIZED (SELECT x, y FROM q, e WHERE p < cut - 1),
 tr AS MATERIALIZED (SELECT (x - {mean}) / {spread} AS x, y, {weight} AS k FROM t0),
 it(i, w, b) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT i + 1, w - (gw * hb - gb * hwb) / (hw * hb - hwb * hwb), b - (gb * hw - gw * hwb) / (hw * hb - hwb * hwb)
  FROM (SELECT i, w, b, sum(k * (s - y) * x) + {alpha} * w AS gw, sum(k * (s - y)) AS gb, sum(k * s * (1 - s) * x * x) + {alpha} AS hw,
    sum(k * s * (1 - s) * x) AS hwb, sum(k * s * (1 - s)) AS hb
   FROM (SELECT i, w, b, x, y, k, 1 / (1 + exp(-(w * x + b))) AS s FROM it, tr) GROUP BY 1, 2, 3) WHERE i < 14),
 f AS (SELECT w, b FROM it WHERE i = 14) {select}"""


_FIT = "SELECT round(w, 4) AS coefficient, round(b, 4) AS intercept, (SELECT count(*) FROM q, e WHERE p >= cut AND w * x + b > 0) AS called_up FROM f"


def _fitted(spark, model, test):
    """Coefficient and intercept of a one-feature fit, and how many test rows it calls up."""
    up = Z.probability(model.transform(Z.assembled(test, ONE))).filter("p > 0.5").count()
    row = (round(float(model.coefficients[0]), 4), round(float(model.intercept), 4), up)
    return spark.createDataFrame([row], "coefficient double, intercept double, called_up long")


@query("m01_model_factory", _logistic_sql("1::DOUBLE", _FIT))
def m01(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*ONE, "up"])
    model = Z.fit_model({"family": "linear", "params": {"alpha": 1.0}}, "classification", train, ONE, "up")
    return _fitted(spark, model, test)


_ONE = "c AS (SELECT covar_pop(fwd, dist_hi) AS cv, var_pop(dist_hi) AS v, avg(fwd) AS my, avg(dist_hi) AS mx, count(*) AS n FROM pb)"


@query(
    "m02_elastic_net",
    f"""WITH {WIDE}, {PROBE}, {_ONE}, w AS (SELECT 0 AS l1, cv / (v + 0.01::DOUBLE) AS w FROM c UNION ALL SELECT 1, sign(cv) * greatest(abs(cv) - 0.01::DOUBLE, 0) / v FROM c)
 SELECT l1, round(w, 5) AS coefficient, round(my - w * mx, 5) AS intercept FROM w, c""",
)
def m02(spark, sf_dir):
    df = probe_frame(spark, sf_dir, [*ONE, "fwd"])
    rows = []
    for l1 in (0, 1):
        m = Z.elastic_net(df, ["dist_hi"], "fwd", 0.01, float(l1))
        rows.append((l1, round(float(m.coefficients[0]), 5), round(float(m.intercept), 5)))
    return spark.createDataFrame(rows, "l1 int, coefficient double, intercept double")


@query("m03_logistic", _logistic_sql("10::DOUBLE", _FIT))
def m03(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*ONE, "up"])
    return _fitted(spark, Z.logistic(train, ONE, "up", 10.0), test)


@query(
    "m04_ridge",
    f"WITH {WIDE}, {PROBE}, {_ONE} SELECT round(cv * n / (v * n + 100), 6) AS coefficient, round(my - cv * n / (v * n + 100) * mx, 6) AS intercept FROM c",
)
def m04(spark, sf_dir):
    m = Z.ridge(probe_frame(spark, sf_dir, [*ONE, "fwd"]), ["dist_hi"], "fwd", 100.0)
    rows = [(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))]
    return spark.createDataFrame(rows, "coefficient double, intercept double")


@query(
    "m04_rolling_ridge",
    f"""WITH {WIDE}, {PROBE}, q AS (SELECT *, (dense_rank() OVER (ORDER BY date) - 1) // 21 AS b FROM pb),
 s AS (SELECT b, count(*) AS n, sum(dist_hi) AS sx, sum(fwd) AS sy, sum(dist_hi * dist_hi) AS sxx, sum(dist_hi * fwd) AS sxy FROM q GROUP BY 1),
 r AS (SELECT b, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy
  FROM s WINDOW w AS (ORDER BY b RANGE BETWEEN 36 PRECEDING AND 1 PRECEDING)),
 c AS (SELECT b, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS k, sx / n AS mx, sy / n AS my FROM r WHERE n > 0)
 SELECT ticker, date, round(my + k * (dist_hi - mx), 6) AS prediction FROM q JOIN c USING (b)""",
)
def m04_rolling(spark, sf_dir):
    out = Z.rolling_ridge(probe_frame(spark, sf_dir, [*ONE, "fwd"]), ["dist_hi"], "fwd")
    return out.select(*KEY, F.round("prediction", 6).alias("prediction"))


@query("m05_gradient_boosting")
def m05(spark, sf_dir):
    """The last fifth of the training dates stops the fit early; the date before them is purged."""
    train, _ = _split(spark, sf_dir, [*FEW, "up"])
    early, late = _early_late(train)
    model = Z.fit_model({"family": "gbm"}, "classification", early, FEW, "up", late)
    return _coef(model, FEW, train)


@query("m06_random_forest")
def m06(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*FEW, "up"])
    est = Z.build_model({"family": "random_forest", "params": {"trees": 400, "weight": "weight"}}, "classification", "up")
    return _coef(est.fit(Z.assembled(Z.balanced_weights(train, "up"), FEW)), FEW, train)


@query(
    "m07_balanced_weights",
    f"WITH {WIDE}, {PROBE}, x AS (SELECT CAST(fwd > 0 AS INTEGER) AS up FROM pb) SELECT up, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM x GROUP BY 1",
)
def m07(spark, sf_dir):
    df = Z.balanced_weights(probe_frame(spark, sf_dir, ["up"]), "up")
    return df.groupBy("up").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("m07_balanced_logistic", _logistic_sql("10::DOUBLE", _FIT, balanced=True))
def m07_fit(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*ONE, "up"])
    return _fitted(spark, Z.balanced_logistic(train, ONE, "up", 0.1), test)


@query("m08_logistic_unpenalised", _logistic_sql("0::DOUBLE", _FIT))
def m08(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*ONE, "up"])
    return _fitted(spark, Z.logistic(train, ONE, "up", 1e-6), test)


def _bayes_sql() -> str:
    stats = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) + 1e-9 AS v_{f}" for f in FEW)
    ll = " ".join(f"- 0.5 * (ln(2 * pi() * v_{f}) + (x.{f} - m_{f}) * (x.{f} - m_{f}) / v_{f})" for f in FEW)
    return f"""WITH {WIDE}, {PROBE}, x AS MATERIALIZED (SELECT *, CAST(fwd > 0 AS INTEGER) AS up FROM pb),
 s AS (SELECT up AS k, count(*) / (SELECT count(*) FROM x) AS prior, {stats} FROM x GROUP BY 1),
 l AS (SELECT x.ticker, x.date, k, ln(prior) {ll} AS ll FROM x, s)
 SELECT ticker, date, round(1 / (1 + exp(sum(CASE WHEN k = 0 THEN ll ELSE -ll END))), 6) AS p FROM l GROUP BY 1, 2"""


@query("m09_naive_bayes", _bayes_sql())
def m09(spark, sf_dir):
    df = probe_frame(spark, sf_dir, [*FEW, "up"])
    return rounded(Z.bayes_probability(df, Z.bayes_table(df, FEW, "up"), FEW, "up"), KEY, 6, ["p"])


@query("m10_perceptron")
def m10(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*FEW, "up"])
    scaler = Z.fit_scaler(train, FEW)
    est = Z.build_model({"family": "mlp", "params": {"layers": [len(FEW), 128, 64, 2], "epochs": 200}}, "classification", "up")
    model = est.fit(Z.assembled(Z.standardize(train, scaler, FEW), FEW))
    out = Z.probability(model.transform(Z.assembled(Z.standardize(test, scaler, FEW), FEW)))
    return out.select(*KEY, F.round("p", 6).alias("p"))


@query("m11_lasso_overlap")
def m11(spark, sf_dir):
    df = probe_frame(spark, sf_dir, [*FEATS, "up"])
    return Z.lasso_overlap(df, FEATS, "up", 50.0, 4)


_QFIT_STEPS = 24


def _quantile_sql() -> str:
    """Majorised quantile regression of ``fwd`` on one feature, and the loss of the ordered edges on the test dates."""
    level = "CASE " + " ".join(f"WHEN tau = {t}::DOUBLE THEN '{n}'" for n, t in TAUS.items()) + " END"
    taus = ", ".join(f"({t}::DOUBLE)" for t in TAUS.values())
    return f"""WITH RECURSIVE {WIDE}, {PROBE},
 q AS MATERIALIZED (SELECT ticker, date, dist_hi AS x, fwd AS y, dense_rank() OVER (ORDER BY date) - 1 AS p FROM pb),
 e AS (SELECT floor(0.7::DOUBLE * (max(p) + 1)) AS cut FROM q), tr AS MATERIALIZED (SELECT x, y FROM q, e WHERE p < cut - 1),
 ep AS (SELECT 0.001::DOUBLE * stddev_pop(y) AS e, avg(y) AS m FROM tr), ta(tau) AS (VALUES {taus}),
 it(i, tau, w, b) AS (SELECT 0, tau, 0::DOUBLE, m FROM ta, ep UNION ALL
  SELECT i + 1, tau, (s * bx - sx * b0) / (s * sxx - sx * sx), (sxx * b0 - sx * bx) / (s * sxx - sx * sx)
  FROM (SELECT i, tau, sum(k) AS s, sum(k * x) AS sx, sum(k * x * x) AS sxx, sum(k * x * y) + (2 * tau - 1) * sum(x) AS bx,
    sum(k * y) + (2 * tau - 1) * count(*) AS b0
   FROM (SELECT i, tau, x, y, 1 / (ep.e + abs(y - w * x - b)) AS k FROM it, tr, ep) GROUP BY 1, 2) WHERE i < {_QFIT_STEPS}),
 f AS (SELECT tau, w, b, row_number() OVER (ORDER BY tau) AS k FROM it WHERE i = {_QFIT_STEPS}),
 te AS (SELECT ticker, date, y, list_sort(list(w * x + b)) AS edges FROM q, e, f WHERE p >= cut GROUP BY 1, 2, 3)
 SELECT {level} AS level, round(w, 5) AS coefficient, round(b, 5) AS intercept,
  round(avg(greatest(tau * (y - edges[k]), (tau - 1) * (y - edges[k]))), 6) AS pinball FROM f, te GROUP BY tau, w, b, k"""


@query("m14_fitted_bands", _quantile_sql())
def m14_fitted(spark, sf_dir):
    """Five levels fitted on the training dates; coefficients and the loss on the test dates."""
    train, test = _split(spark, sf_dir, [*ONE, "fwd"])
    model = fit_quantiles(train, ONE, "fwd", steps=_QFIT_STEPS, tolerance=0.0)
    rows = [(n, round(float(w[1]), 5), round(float(w[0]), 5)) for n, w in zip(model.taus, model.weights)]
    found = spark.createDataFrame(rows, "level string, coefficient double, intercept double")
    return found.join(model.loss(test, "fwd"), "level").withColumn("pinball", F.round("pinball", 6))


@query("i08_selection_overlap")
def i08(spark, sf_dir):
    df = probe_frame(spark, sf_dir, [*FEATS, "up"])
    return Z.lasso_overlap(df, FEATS, "up", 50.0, 6).filter("in_lasso and in_mi").select("feature")


def _tone(spark, sf_dir, grid):
    """Lexicon tone of the documents, dealt by id to suppliers and days, on the dates of ``grid``."""
    lexicon = spark.createDataFrame(list(LEXICON), "word string, valence double")
    scores = lexicon_scores(table(spark, sf_dir, "documents"), "text", lexicon, ("doc_id",))
    first, last = grid.agg(F.min("date"), F.max("date")).first()
    days, id_ = (last - first).days + 1, F.col("doc_id")
    day = F.date_add(F.lit(first), F.pmod(F.xxhash64(id_), F.lit(days)).cast("int"))
    tickers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("ticker"), (F.row_number().over(Window.orderBy("s_suppkey")) - 1).alias("__k"))
    dealt = scores.withColumn("__k", F.pmod(id_, F.lit(tickers.count()))).withColumn("date", day).join(tickers, "__k")
    return sentiment_panel(dealt, grid.select(*KEY)).withColumnRenamed("score", "tone")


@query("m12_stacking")
def m12(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*FEW, "up"])
    news = _tone(spark, sf_dir, train.unionByName(test))
    train, test = (d.join(news, KEY, "left") for d in (train, test))
    out = Z.stacked(train, test, FEW, "up", folds=3, sentiment=["tone"])
    return out.select(*KEY, *[F.round(c, 6).alias(c) for c in ("p_lr", "p_nb", "p_mlp", "p_sent", "p")])


@query("m16_walk_forward_training")
def m16(spark, sf_dir):
    df = L.forward_returns(T.rate_of_change(daily_panel(spark, sf_dir), (5, 10, 20)), (5,))
    roles = S.walk_forward_roles(df, S.walk_forward_folds(df, 2, 1, 1, 1))
    config = {"family": "linear", "params": {"alpha": 0.01}}
    return Z.train_walk_forward(df, ["roc_5", "roc_10", "roc_20"], "y_logret_h5", roles, config, "regression")


@query("m17_transfer")
def m17(spark, sf_dir):
    source, target = N.probe_set(daily_panel(spark, sf_dir)), N.probe_set(wide_panel(spark, sf_dir))
    common = [c for c in Z.common_columns(source, target, (*KEY, "fwd")) if c in FEW]
    source, target = (materialize(d.select(*KEY, *common, "fwd"), "probe") for d in (source, target))
    return Z.transfer_evaluate(source, target, common, "fwd", {"family": "linear", "params": {"alpha": 0.01}})


@query("m20_top_features")
def m20(spark, sf_dir):
    """Up to 1 000 rounds; the last fifth of the training dates stops the fit early."""
    train, _ = _split(spark, sf_dir, [*FEATS, "up"])
    early, late = _early_late(train)
    model = Z.fit_model({"family": "gbm"}, "classification", early, FEATS, "up", late)
    return Z.top_features(Z.coefficients(model, FEATS, train), 5)


@query("m21_bias_variance")
def m21(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*FEW, "up"])
    return Z.bias_variance(train, test, FEW, "up", KEY, rounds=20)


@query("m22_checkpoint", _logistic_sql("1::DOUBLE", _FIT))
def m22(spark, sf_dir):
    train, test = _split(spark, sf_dir, [*ONE, "up"])
    path = scratch_path(spark, "model")
    Z.save_checkpoint(ONE, Z.logistic(train, ONE, "up"), path)
    loaded = Z.load_checkpoint(path)
    up = Z.probability(loaded.transform(test)).filter("p > 0.5").count()
    row = (round(float(loaded.stages[-1].coefficients[0]), 4), round(float(loaded.stages[-1].intercept), 4), up)
    return spark.createDataFrame([row], "coefficient double, intercept double, called_up long")


_SCALED = _FIT.replace("w * x + b", "w * (x - (SELECT avg(x) FROM t0)) / ((SELECT stddev_pop(x) FROM t0) + 1e-9) + b")


@query("m22_checkpoint_scaled", _logistic_sql("1::DOUBLE", _SCALED, scaled=True))
def m22_scaled(spark, sf_dir):
    """A fit on standardised columns, saved with its scaler and applied to plain columns after loading."""
    train, test = _split(spark, sf_dir, [*ONE, "up"])
    scaler, path = Z.ColumnScaler.fitted(train, ONE), scratch_path(spark, "model")
    Z.save_checkpoint(ONE, Z.logistic(scaler.transform(train), scaler.outputs(), "up"), path, scaler)
    loaded = Z.load_checkpoint(path)
    up = Z.probability(loaded.transform(test)).filter("p > 0.5").count()
    row = (round(float(loaded.stages[-1].coefficients[0]), 4), round(float(loaded.stages[-1].intercept), 4), up)
    return spark.createDataFrame([row], "coefficient double, intercept double, called_up long")


@query("e17_signal_probe")
def e17(spark, sf_dir):
    df = probe_frame(spark, sf_dir, [*FEW, "up"])
    return Z.signal_probe(df, FEW, "up", _holdout(df, purge=0))


@query("i05_recent_importance")
def i05(spark, sf_dir):
    df = probe_frame(spark, sf_dir, [*FEATS, "up"])
    recent = materialize(date_positions(df, "date", "p", "n").filter("p >= floor(0.7D * n)"), "recent")
    return Z.recent_importance(df, FEATS, "up", 5, recent)
