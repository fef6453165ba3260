"""Registered queries: metrics, backtest, bands, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.expr import DAILY as AX
from barloom.operators import backtest as B
from barloom.operators import bands as D
from barloom.operators import labels as L
from barloom.operators import metrics as M
from barloom.operators import splits as S
from barloom.operators.bootstrap import bootstrap_auc_gap, poisson_steps
from barloom.operators.ranking import with_ordinal
from barloom.plans.registry import query, rounded
from barloom.session import materialize
from barloom.plans.sqltext import DAILY, WIDE, ahead, full, lag, lead, rank_pct
from barloom.sources.datasets import daily_panel, table, wide_panel

KEY = ["ticker", "date"]
R1 = f"(ln(close) - {lag('ln(close)')})"
SCORED = """sc AS MATERIALIZED (SELECT doc_id, quality AS y, toxic AS y2, CAST(n_chars AS DOUBLE) AS s, n_chars / (n_chars + 1000.0::DOUBLE) AS p,
 CAST(n_chars % 1000 AS DOUBLE) / 1000 AS q, CASE WHEN n_chars / (n_chars + 1000.0::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS pred
 FROM labels JOIN documents USING (doc_id))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: y, y2, scores s and q, probability p, class pred."""
    n = F.col("n_chars")
    p = n / (n + 1000.0)
    return (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("y"),
            F.col("toxic").alias("y2"),
            n.cast("double").alias("s"),
            p.alias("p"),
            ((n % 1000).cast("double") / 1000).alias("q"),
            F.when(p >= 0.5, 1).otherwise(0).alias("pred"),
        )
    )


PRED = f"""pr AS MATERIALIZED (SELECT ticker, date, -({R1}) AS p, {lead('ln(close)')} - ln(close) AS y FROM wide)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversal score p and the next log return y of the wide panel."""
    return wide_panel(spark, sf_dir).select(
        *KEY, (-AX.log_return(F.col("close"))).alias("p"), L.forward_return(1).alias("y")
    )


def _auc_sql(y: str, s: str, table_: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}{s}"
    inner = f"""SELECT {by + ',' if by else ''} {y} AS y, rank() OVER ({part}ORDER BY {s}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS rk FROM {table_} WHERE {y} IS NOT NULL AND {s} IS NOT NULL"""
    return f"""SELECT {by + ',' if by else ''} (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM ({inner}) {'GROUP BY ' + by if by else ''}"""


@query("e01_roc_auc", f"WITH {SCORED} SELECT round(auc, 6) AS auc FROM ({_auc_sql('y', 'q', 'sc')})")
def e01(spark, sf_dir):
    return rounded(M.roc_auc(scored(spark, sf_dir), "y", "q"), [])


@query(
    "e01_roc_auc_by_date",
    f"WITH {WIDE}, {PRED}, b AS (SELECT date, CAST(y > 0 AS INTEGER) AS up, p FROM pr WHERE y IS NOT NULL AND p IS NOT NULL) SELECT date, round(auc, 6) AS auc FROM ({_auc_sql('up', 'p', 'b', 'date')})",
)
def e01_date(spark, sf_dir):
    df = predictions(spark, sf_dir).dropna().withColumn("up", (F.col("y") > 0).cast("int"))
    return rounded(M.roc_auc(df, "up", "p", ["date"]), ["date"])


@query(
    "e02_roc_auc_default",
    f"WITH {SCORED}, o AS (SELECT *, 1 AS one FROM sc) SELECT round(coalesce(a.auc, 0.5), 6) AS auc, coalesce(b.auc, 0.5)::DOUBLE AS auc_one_class FROM ({_auc_sql('y', 's', 'o')}) a, ({_auc_sql('one', 's', 'o')}) b",
)
def e02(spark, sf_dir):
    df = scored(spark, sf_dir).withColumn("one", F.lit(1))
    a = M.roc_auc(df, "y", "s", one_class=0.5)
    b = M.roc_auc(df, "one", "s", one_class=0.5)
    return a.select(F.round("auc", 6).alias("auc"), b.scalar().alias("auc_one_class"))


@query("e03_accuracy", f"WITH {SCORED} SELECT round(avg(CAST(y = pred AS INTEGER)), 6) AS acc FROM sc")
def e03(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(M.accuracy(F.col("y"), F.col("pred")), 6).alias("acc"))


_E04 = f"""WITH {SCORED} SELECT round(avg(CAST(y = pred AS INTEGER)), 6) AS accuracy,
 round((avg(CASE WHEN y = 1 THEN CAST(pred = 1 AS INTEGER) END) + avg(CASE WHEN y = 0 THEN CAST(pred = 0 AS INTEGER) END)) / 2, 6) AS balanced_accuracy,
 round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss, round(2 * avg((p - y) * (p - y)), 6) AS brier FROM sc"""


@query("e04_classification_report", _E04)
def e04(spark, sf_dir):
    return rounded(M.classification_report(scored(spark, sf_dir), "y", "pred", "p"), [])


@query(
    "e05_brier",
    f"WITH {SCORED} SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg((1 - p - (1 - y)) * (1 - p - (1 - y)) + (p - y) * (p - y)), 6) AS brier_classes FROM sc",
)
def e05(spark, sf_dir):
    y, p = F.col("y"), F.col("p")
    return scored(spark, sf_dir).agg(
        F.round(M.brier(y, p), 6).alias("brier"),
        F.round(M.brier_classes(y, F.array(1 - p, p)), 6).alias("brier_classes"),
    )


_IC = f"""rk AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rp FROM pr WHERE y IS NOT NULL AND p IS NOT NULL)"""


@query(
    "e06_regression_report",
    f"""WITH {WIDE}, {PRED}, {_IC}, k AS (SELECT * FROM pr WHERE y IS NOT NULL AND p IS NOT NULL)
 SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2,
  round(avg(CASE WHEN y <> 0 THEN CAST(sign(y) = sign(p) AS INTEGER) END), 6) AS directional_accuracy,
  round((SELECT corr(ry, rp) FROM rk), 6) AS ic FROM k""",
)
def e06(spark, sf_dir):
    return rounded(M.regression_report(predictions(spark, sf_dir).dropna(), "y", "p"), [])


@query("e07_information_coefficient", f"WITH {WIDE}, {PRED}, {_IC} SELECT round(corr(ry, rp), 6) AS ic FROM rk")
def e07(spark, sf_dir):
    return rounded(M.information_coefficient(predictions(spark, sf_dir), "y", "p"), [])


@query(
    "e08_directional_accuracy",
    f"WITH {WIDE}, {PRED} SELECT ticker, round(avg(CASE WHEN y <> 0 AND p IS NOT NULL THEN CAST(sign(y) = sign(p) AS INTEGER) END), 6) AS da FROM pr GROUP BY 1",
)
def e08(spark, sf_dir):
    df = predictions(spark, sf_dir)
    return df.groupBy("ticker").agg(F.round(M.directional_accuracy(F.col("y"), F.col("p")), 6).alias("da"))


@query(
    "e09_pinball",
    f"WITH {WIDE}, {PRED} SELECT "
    + ", ".join(f"round(avg(greatest({t}::DOUBLE * (y - p), ({t}::DOUBLE - 1) * (y - p))), 6) AS {n}" for n, t in D.TAUS.items())
    + " FROM pr WHERE y IS NOT NULL AND p IS NOT NULL",
)
def e09(spark, sf_dir):
    df = predictions(spark, sf_dir)
    return df.agg(*[F.round(M.pinball(F.col("y"), F.col("p"), t), 6).alias(n) for n, t in D.TAUS.items()])


_E10 = f"""WITH {SCORED}, c AS (SELECT k AS class, count(CASE WHEN y = k THEN 1 END) AS support, count(CASE WHEN pred = k THEN 1 END) AS called,
  count(CASE WHEN y = k AND pred = k THEN 1 END) AS hit FROM sc, (VALUES (0), (1)) t(k) GROUP BY 1),
 m AS (SELECT class, support, hit, coalesce(hit / nullif(called, 0), 0)::DOUBLE AS p, coalesce(hit / nullif(support, 0), 0)::DOUBLE AS r FROM c),
 f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0)::DOUBLE AS f FROM m)
 SELECT CAST(class AS VARCHAR) AS row, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM f
 UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM f
 UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
 UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f"""


@query("e10_class_table", _E10)
def e10(spark, sf_dir):
    return rounded(M.class_table(scored(spark, sf_dir), "y", "pred"), ["row", "support"])


# ---- bands -------------------------------------------------------------------

HS = (1, 5, 20)
# Rows x horizons with the trailing volatility bucket, and the role of the date.
_LONG = f"""b0 AS MATERIALIZED (SELECT ticker, date, close, {R1} AS r1 FROM daily),
 b1 AS MATERIALIZED (SELECT ticker, date, close, {full('stddev_samp', 'r1', 20)} AS v, """ + ", ".join(
    f"{lead('ln(close)', h)} - ln(close) AS f{h}" for h in HS
) + f""" FROM b0),
 b2 AS MATERIALIZED (SELECT *, CAST(least(floor({rank_pct('v', 'date')} * 3), 2) AS INTEGER) AS bucket FROM b1 WHERE v IS NOT NULL),
 dt AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS dp, count(*) OVER () AS dn FROM (SELECT DISTINCT date FROM b2)),
 lg AS MATERIALIZED (""" + " UNION ALL ".join(
    f"SELECT ticker, date, close AS p0, bucket, {h} AS horizon, f{h} AS y, CASE WHEN dp >= floor(0.8::DOUBLE * dn) THEN 'test' WHEN dp >= floor(0.68::DOUBLE * dn) THEN 'cal' ELSE 'train' END AS role FROM b2 JOIN dt USING (date) WHERE f{h} IS NOT NULL"
    for h in HS
) + ")"
_BANDS = (
    _LONG
    + ", bd AS MATERIALIZED (SELECT horizon, bucket, "
    + ", ".join(f"quantile_cont(y, {t}) AS {n}" for n, t in D.TAUS.items())
    + " FROM lg WHERE role = 'train' GROUP BY 1, 2)"
    + """, cs AS (SELECT horizon, greatest(q05 - y, y - q95) AS s FROM lg JOIN bd USING (horizon, bucket) WHERE role = 'cal'),
 cr AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY s) AS k, count(*) OVER (PARTITION BY horizon) AS n FROM cs),
 dl AS MATERIALIZED (SELECT horizon, greatest(s, 0) AS delta FROM cr WHERE k = least(ceil(0.9::DOUBLE * (n + 1)), n)),
 tb AS MATERIALIZED (SELECT ticker, date, p0, lg.horizon, lg.bucket, y, q05 - delta AS q05, q25, q50, q75, q95 + delta AS q95
  FROM lg JOIN bd ON lg.horizon = bd.horizon AND lg.bucket = bd.bucket JOIN dl ON dl.horizon = lg.horizon WHERE role = 'test')"""
)


def long_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (ticker, date, horizon): outcome y, volatility bucket, role."""
    from barloom.operators.blocks import date_positions
    from barloom.operators.ranking import with_ranks

    df = daily_panel(spark, sf_dir).withColumn("r1", AX.log_return(F.col("close")))
    df = df.select(
        *KEY,
        F.col("close").alias("p0"),
        AX.full(F.stddev_samp, F.col("r1"), 20).alias("v"),
        *[L.forward_return(h).alias(f"f{h}") for h in HS],
    ).filter("v is not null")
    df = with_ranks(df, ["date"], {"rk": "v"})
    df = df.withColumn("bucket", F.least(F.floor(F.col("rk") * 3), F.lit(2)).cast("int"))
    dates = date_positions(df, "date", "dp", "dn")
    share = lambda f: F.floor(F.lit(f) * F.col("dn"))
    role = F.when(F.col("dp") >= share(0.8), "test").when(F.col("dp") >= share(0.68), "cal").otherwise("train")
    df = df.join(dates.select("date", role.alias("role")), "date")
    parts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("y")) for h in HS])
    long = df.select(*KEY, "p0", "bucket", "role", F.explode(parts).alias("h"))
    # Training, calibration and test rows are read separately below.
    return materialize(long.select(*KEY, "p0", "bucket", "role", "h.horizon", "h.y").filter("y is not null"), "outcomes")


def test_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated bands on the test rows."""
    long = long_outcomes(spark, sf_dir)
    table_ = D.empirical_bands(long.filter("role = 'train'"), "y", ["horizon", "bucket"])
    cal = long.filter("role = 'cal'").join(table_, ["horizon", "bucket"])
    delta = D.conformal_delta(cal, "y", ["horizon"])
    test = long.filter("role = 'test'").join(table_, ["horizon", "bucket"])
    return D.widen(test, delta, ["horizon"])


@query(
    "m14_empirical_bands",
    f"WITH {DAILY}, {_BANDS} SELECT horizon, bucket, " + ", ".join(f"round({q}, 6) AS {q}" for q in D.TAUS) + " FROM bd",
)
def m14(spark, sf_dir):
    long = long_outcomes(spark, sf_dir).filter("role = 'train'")
    return rounded(D.empirical_bands(long, "y", ["horizon", "bucket"]), ["horizon", "bucket"])


@query("m15_conformal_delta", f"WITH {DAILY}, {_BANDS} SELECT horizon, round(delta, 6) AS delta FROM dl")
def m15(spark, sf_dir):
    long = long_outcomes(spark, sf_dir)
    table_ = D.empirical_bands(long.filter("role = 'train'"), "y", ["horizon", "bucket"])
    cal = long.filter("role = 'cal'").join(table_, ["horizon", "bucket"])
    return rounded(D.conformal_delta(cal, "y", ["horizon"]), ["horizon"])


@query(
    "m15_calibrated_bands",
    f"WITH {DAILY}, {_BANDS} SELECT ticker, date, horizon, " + ", ".join(f"round({q}, 6) AS {q}" for q in D.TAUS) + " FROM tb",
)
def m15_bands(spark, sf_dir):
    return rounded(test_bands(spark, sf_dir), [*KEY, "horizon"], 6, list(D.TAUS))


@query(
    "e11_band_report",
    f"""WITH {DAILY}, {_BANDS} SELECT horizon, round(avg(CAST(y BETWEEN q05 AND q95 AS INTEGER)), 6) AS cover90,
 round(avg(CAST(y BETWEEN q25 AND q75 AS INTEGER)), 6) AS cover50, round(avg(q95 - q05), 6) AS width90,
 round((exp(avg(q95 - q05) / 2) - 1) * 100, 5) AS half_band_pct FROM tb GROUP BY 1""",
)
def e11(spark, sf_dir):
    return rounded(M.band_report(test_bands(spark, sf_dir)), ["horizon"], {"half_band_pct": 5})


@query(
    "e12_price_cone",
    f"WITH {DAILY}, {_BANDS} SELECT horizon, "
    + ", ".join(f"round(100 * exp(avg({q})), 5) AS {q.replace('q', 'p')}" for q in D.TAUS)
    + " FROM tb GROUP BY 1",
)
def e12(spark, sf_dir):
    return rounded(M.price_cone(test_bands(spark, sf_dir)), ["horizon"], 5)


# A probability per (ticker, date, horizon): the volatility rank shrunk by the horizon.
_PROB = f"""pv AS MATERIALIZED (SELECT ticker, date, horizon, y, CAST(y > 0 AS INTEGER) AS up, 1 / (1 + exp(-(0.2 + horizon / 20.0::DOUBLE) * 3 * (p0 % 10 - 5) / 5)) AS p FROM lg)"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("horizon")
    x = -(0.2 + h / 20.0) * 3 * (F.col("p0") % 10 - 5) / 5
    return long_outcomes(spark, sf_dir).select(
        *KEY, "horizon", "y", (F.col("y") > 0).cast("int").alias("up"), (1 / (1 + F.exp(x))).alias("p")
    )


@query(
    "e13_selective_accuracy",
    f"""WITH {DAILY}, {_LONG}, {_PROB}, k AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY abs(p - 0.5) DESC, ticker, date) AS k,
  count(*) OVER (PARTITION BY horizon) AS n, CAST((p >= 0.5) = (up >= 0.5) AS INTEGER) AS hit FROM pv) SELECT horizon, """
    + ", ".join(
        f"round(avg(CASE WHEN k <= greatest(1, floor({c}::DOUBLE * n)) THEN hit END), 6) AS acc_cov{round(c * 100)}"
        for c in M.COVERAGES
    )
    + " FROM k GROUP BY 1",
)
def e13(spark, sf_dir):
    return rounded(M.selective_accuracy(probabilities(spark, sf_dir), "up", "p", KEY), ["horizon"])


@query(
    "e14_curvature",
    f"""WITH {DAILY}, {_LONG}, {_PROB}, k AS (SELECT lead(p) OVER z - 2 * p + lag(p) OVER z AS b FROM pv WINDOW z AS (PARTITION BY ticker, date ORDER BY horizon))
 SELECT round(avg(b * b), 6) AS curvature FROM k""",
)
def e14(spark, sf_dir):
    return rounded(M.curvature(probabilities(spark, sf_dir), "p", KEY), [])


@query(
    "e15_auc_comparison",
    f"""WITH {DAILY}, {_LONG}, {_PROB}, i AS ({_auc_sql('up', 'p', 'pv', 'horizon')}),
 z AS (SELECT horizon, up, -y AS s FROM pv), c AS ({_auc_sql('up', 's', 'z', 'horizon')}),
 j AS (SELECT CAST(i.horizon AS VARCHAR) AS horizon, i.auc AS independent, c.auc AS coupled FROM i JOIN c ON i.horizon = c.horizon),
 u AS (SELECT * FROM j UNION ALL SELECT 'mean', avg(independent), avg(coupled) FROM j)
 SELECT horizon, round(independent, 6) AS independent, round(coupled, 6) AS coupled, round(coupled - independent, 6) AS delta FROM u""",
)
def e15(spark, sf_dir):
    df = probabilities(spark, sf_dir).withColumn("s", -F.col("y"))
    a = M.roc_auc(df, "up", "p", ["horizon"])
    b = M.roc_auc(df, "up", "s", ["horizon"])
    return rounded(M.compare_tables(b, a), ["horizon"])


def _drawn(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


_W = " + ".join(f"CAST(u >= {t!r}::DOUBLE AS INTEGER)" for t in poisson_steps())
_E16_REPS = f"rp AS (SELECT range AS rep, {_drawn("'0:' || range || ':a'")} % 2147483646 + 1 AS fa, {_drawn("'0:' || range || ':b'")} % 2147483647 AS fb FROM range(1000))"


def _e16_auc(score: str) -> str:
    return f"""SELECT rep, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) END AS auc FROM (
 SELECT *, sum(neg) OVER (PARTITION BY rep ORDER BY {score}) - neg AS below FROM (
 SELECT rep, {score}, CAST(sum(w * y) AS DOUBLE) AS pos, CAST(sum(w * (1 - y)) AS DOUBLE) AS neg FROM dw GROUP BY 1, 2)) GROUP BY 1"""


@query(
    "e16_bootstrap_auc_gap",
    f"""WITH {SCORED}, {_E16_REPS}, h AS (SELECT *, {_drawn("CAST(doc_id AS VARCHAR)")} % 2147483647 AS h FROM sc WHERE y IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL),
 dr AS (SELECT rep, y, p, q, CAST((h * fa + fb) % 2147483647 AS DOUBLE) / 2147483647 AS u FROM h CROSS JOIN rp),
 dw AS MATERIALIZED (SELECT rep, y, p, q, {_W} AS w FROM dr),
 g AS (SELECT coalesce(x.auc - z.auc, 0) AS gap FROM ({_e16_auc('p')}) x JOIN ({_e16_auc('q')}) z USING (rep)),
 o AS (SELECT (SELECT auc FROM ({_auc_sql('y', 'p', 'h')})) - (SELECT auc FROM ({_auc_sql('y', 'q', 'h')})) AS gap)
 SELECT round((SELECT gap FROM o), 6) AS gap, round(quantile_cont(gap, 0.025), 6) AS lo, round(quantile_cont(gap, 0.975), 6) AS hi,
 least(2 * least(avg(CAST(gap <= 0 AS INTEGER)), avg(CAST(gap >= 0 AS INTEGER))), 1.0::DOUBLE) AS p_value FROM g""",
)
def e16(spark, sf_dir):
    return rounded(bootstrap_auc_gap(scored(spark, sf_dir), "y", "p", "q", ["doc_id"], 1000), ["p_value"])


@query(
    "e18_fold_summary",
    f"""WITH {WIDE}, {PRED}, b AS (SELECT date, CAST(y > 0 AS INTEGER) AS up, p FROM pr WHERE y IS NOT NULL AND p IS NOT NULL), a AS ({_auc_sql('up', 'p', 'b', 'date')}),
 c AS (SELECT date, avg(CAST((p > 0) = (up = 1) AS INTEGER)) AS acc FROM b GROUP BY 1)
 SELECT round(avg(acc), 6) AS mean_acc, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, count(*) AS n_paths FROM a JOIN c USING (date)""",
)
def e18(spark, sf_dir):
    df = predictions(spark, sf_dir).dropna().withColumn("up", (F.col("y") > 0).cast("int"))
    hit = ((F.col("p") > 0) == (F.col("up") == 1)).cast("double")
    acc = df.groupBy("date").agg(F.avg(hit).alias("acc"))
    return rounded(M.fold_summary(M.roc_auc(df, "up", "p", ["date"]).join(acc, "date")), ["n_paths"])


@query(
    "m18_persistence_baseline",
    f"""WITH {DAILY}, b0 AS MATERIALIZED (SELECT ticker, date, {R1} AS r1 FROM daily),
 b1 AS (SELECT ticker, date, {full('stddev_samp', 'r1', 252)} AS vol252, CASE WHEN count(r1) OVER {ahead(20)} = 20 THEN stddev_samp(r1) OVER {ahead(20)} END AS f FROM b0),
 b2 AS (SELECT *, CASE WHEN f IS NOT NULL THEN CAST({rank_pct('f', 'date')} >= 0.5 AS INTEGER) END AS y FROM b1),
 dt AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM daily)),
 t AS (SELECT * FROM b2 JOIN dt USING (date) WHERE p >= floor(0.8 * n)) SELECT 'vol252' AS feature, round(auc, 6) AS auc FROM ({_auc_sql('y', 'vol252', 't')})""",
)
def m18(spark, sf_dir):
    from barloom.operators.models import persistence_baseline

    daily = daily_panel(spark, sf_dir)
    df = daily.withColumn("r1", AX.log_return(F.col("close")))
    df = df.select(*KEY, AX.full(F.stddev_samp, F.col("r1"), 252).alias("vol252"), L.forward_volatility(F.col("r1"), 20).alias("h20"))
    df = L.volatility_labels(df, (20,))
    return rounded(persistence_baseline(df, "y20", ["vol252"], S.purged_holdout(daily, 0.8, 1)), ["feature"])


@query("m19_majority_baseline", f"WITH {SCORED} SELECT round(greatest(avg(y), 1 - avg(y)), 6) AS acc, 0.5::DOUBLE AS auc FROM sc")
def m19(spark, sf_dir):
    return scored(spark, sf_dir).agg(
        F.round(M.majority_baseline(F.col("y")), 6).alias("acc"), F.lit(0.5).alias("auc")
    )


_GRID = ", ".join(f"({i}, {i / 20!r}::DOUBLE)" for i in range(21))


@query(
    "m13_blend_weight",
    f"""WITH {SCORED}, g AS (SELECT i, a, y, a * p + (1 - a) * q AS s FROM sc, (VALUES {_GRID}) t(i, a)),
 u AS ({_auc_sql('y', 's', 'g', 'i')}) SELECT round(i / 20.0::DOUBLE, 6) AS a, round(auc, 6) AS auc FROM u ORDER BY round(auc, 12) DESC, i LIMIT 1""",
)
def m13(spark, sf_dir):
    from barloom.operators.models import fit_blend

    return rounded(fit_blend(scored(spark, sf_dir), "y", "p", "q"), [])


# ---- backtest -----------------------------------------------------------------

_LS = f"""ls AS MATERIALIZED (SELECT date, avg(CASE WHEN p >= hi THEN y END) - avg(CASE WHEN p <= lo THEN y END) AS ls_return
 FROM (SELECT * FROM pr WHERE p IS NOT NULL AND y IS NOT NULL) JOIN (SELECT date, quantile_cont(p, 0.8) AS hi, quantile_cont(p, 0.2) AS lo FROM pr WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY 1) USING (date)
 GROUP BY 1 HAVING count(*) >= 5)"""


def long_short(spark, sf_dir):
    df = predictions(spark, sf_dir).dropna()
    return B.long_short_returns(df, "p", "y")


@query("b03_long_short", f"WITH {WIDE}, {PRED}, {_LS} SELECT date, round(ls_return, 6) AS ls_return FROM ls")
def b03(spark, sf_dir):
    return rounded(long_short(spark, sf_dir), ["date"])


@query(
    "b01_equity_curve",
    f"WITH {WIDE}, {PRED}, {_LS} SELECT date, round(sum(ln(1 + coalesce(ls_return / 100, 0))) OVER (ORDER BY date), 6) AS log_equity FROM ls",
)
def b01(spark, sf_dir):
    df = long_short(spark, sf_dir).withColumn("r", F.col("ls_return") / 100)
    return B.equity_curve(df, "r").select("date", F.round(F.log("equity"), 6).alias("log_equity"))


@query(
    "b02_sharpe",
    f"WITH {WIDE}, {PRED}, {_LS} SELECT round(sqrt(252.0::DOUBLE) * avg(ls_return) / nullif(stddev_samp(ls_return), 0), 6) AS sharpe FROM ls",
)
def b02(spark, sf_dir):
    return rounded(B.sharpe_ratio(long_short(spark, sf_dir), "ls_return"), [])


@query(
    "b04_strategy_vs_hold",
    f"""WITH {WIDE}, m AS (SELECT date, avg(r) AS r FROM (SELECT date, {R1.replace('daily', 'wide')} / 100 AS r FROM wide) GROUP BY 1 HAVING avg(r) IS NOT NULL),
 c AS (SELECT date, r, CASE WHEN lag(r) OVER (ORDER BY date) < 0 THEN 1 ELSE 0 END AS call FROM m)
 SELECT date, round(exp(sum(r * (2 * call - 1)) OVER (ORDER BY date)) - 1, 6) AS strategy, round(exp(sum(r) OVER (ORDER BY date)) - 1, 6) AS buy_hold FROM c""",
)
def b04(spark, sf_dir):
    from pyspark.sql import Window

    df = wide_panel(spark, sf_dir).withColumn("r", AX.log_return(F.col("close")) / 100)
    m = df.groupBy("date").agg(F.avg("r").alias("r")).filter("r is not null")
    call = F.when(F.lag("r").over(Window.orderBy("date")) < 0, 1).otherwise(0)
    return rounded(B.strategy_vs_hold(m.withColumn("call", call), "r", "call"), ["date"], 6, ["strategy", "buy_hold"])


# ---- decisions --------------------------------------------------------------

_CH = """ch AS MATERIALIZED (SELECT CAST(ticker AS VARCHAR) AS ticker, date, horizon || 'd' AS horizon, p0, p0 * exp(q50) AS target, p0 * exp(q05) AS range_lo,
 p0 * exp(q95) AS range_hi, CASE WHEN q50 > 0.005::DOUBLE THEN 'buy' WHEN q50 < -0.005::DOUBLE THEN 'sell' ELSE 'hold' END AS signal,
 p0 * exp(q75) AS call_strike, p0 * exp(q25) AS put_strike, q05 AS band_lo_ret, q95 AS band_hi_ret, p0 * exp(y) AS actual FROM tb),
 sd AS MATERIALIZED (SELECT *, actual - target AS error, abs(actual - target) AS abs_error, (actual - target) / greatest(target, 1e-9) AS pct_error,
 actual >= range_lo AND actual <= range_hi AS in_band, 'auto' AS source FROM ch)"""
_MONEY = ["target", "range_lo", "range_hi", "call_strike", "put_strike"]


def choices(spark, sf_dir):
    bands = test_bands(spark, sf_dir).withColumn("actual", F.col("p0") * F.exp("y"))
    out = D.choose(bands).withColumn("horizon", F.concat(F.col("horizon").cast("string"), F.lit("d")))
    return out.withColumns({"ticker": F.col("ticker").cast("string"), "source": F.lit("auto")})


def scored_choices(spark, sf_dir):
    return D.score(choices(spark, sf_dir))


@query(
    "d01_choices",
    f"WITH {DAILY}, {_BANDS}, {_CH} SELECT ticker, date, horizon, signal, "
    + ", ".join(f"round({c} / p0, 6) AS {c}" for c in _MONEY)
    + " FROM ch",
)
def d01(spark, sf_dir):
    df = choices(spark, sf_dir)
    return df.select(*KEY, "horizon", "signal", *[F.round(F.col(c) / F.col("p0"), 6).alias(c) for c in _MONEY])


@query(
    "d02_scores",
    f"WITH {DAILY}, {_BANDS}, {_CH} SELECT ticker, date, horizon, round(error / p0, 6) AS error, round(abs_error / p0, 6) AS abs_error, round(pct_error, 6) AS pct_error, in_band FROM sd",
)
def d02(spark, sf_dir):
    p0 = F.col("p0")
    return scored_choices(spark, sf_dir).select(
        *KEY,
        "horizon",
        F.round(F.col("error") / p0, 6).alias("error"),
        F.round(F.col("abs_error") / p0, 6).alias("abs_error"),
        F.round("pct_error", 6).alias("pct_error"),
        "in_band",
    )


@query(
    "d03_ledger_append",
    f"""WITH {DAILY}, {_BANDS}, {_CH}, l AS (SELECT ticker, date, horizon, source, signal, pct_error, 1 AS batch FROM sd
  UNION ALL SELECT ticker, date, horizon, source, 'hold', pct_error, 2 FROM sd WHERE horizon <> '5d')
 SELECT ticker, date, horizon, source, signal, round(pct_error, 6) AS pct_error FROM l
 QUALIFY row_number() OVER (PARTITION BY ticker, date, horizon, source ORDER BY batch DESC) = 1""",
)
def d03(spark, sf_dir):
    rows = scored_choices(spark, sf_dir)
    again = rows.filter("horizon <> '5d'").withColumn("signal", F.lit("hold"))
    ledger = D.append(D.append(None, rows, 1), again, 2)
    out = D.dedupe_last(ledger, "batch")
    return out.select(*KEY, "horizon", "source", "signal", F.round("pct_error", 6).alias("pct_error"))


@query(
    "d04_coverage_by_ticker",
    f"WITH {DAILY}, {_BANDS}, {_CH} SELECT ticker, round(avg(CAST(in_band AS INTEGER)), 6) AS coverage FROM sd GROUP BY 1",
)
def d04(spark, sf_dir):
    return rounded(D.coverage_by_ticker(scored_choices(spark, sf_dir)), ["ticker"])


@query(
    "d05_per_ticker_delta",
    f"""WITH {DAILY}, {_BANDS}, {_CH}, o AS (SELECT ticker, greatest(band_lo_ret - ln(actual / p0), ln(actual / p0) - band_hi_ret) AS s FROM sd WHERE p0 > 0 AND actual > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY s) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM o)
 SELECT ticker, round(CASE WHEN n >= 20 THEN greatest(s, 0) ELSE 0 END, 6) AS delta FROM k WHERE k = least(ceil(0.9::DOUBLE * (n + 1)), n)""",
)
def d05(spark, sf_dir):
    return rounded(D.per_ticker_delta(scored_choices(spark, sf_dir)), ["ticker"])


@query(
    "d06_manual_choices",
    f"""WITH {DAILY}, {_BANDS}, m AS (SELECT CAST(ticker AS VARCHAR) AS ticker, date, horizon || 'd' AS horizon, p0, p0 * 1.01 AS target, p0 * 0.5 AS lo, p0 * 1.5 AS hi,
  CASE WHEN horizon = 20 THEN NULL ELSE p0 * exp(y) END AS actual FROM tb)
 SELECT ticker, date, horizon, 'manual' AS source, round(ln(lo / p0), 6) AS band_lo_ret, round(ln(hi / p0), 6) AS band_hi_ret,
  round((actual - target) / target, 6) AS pct_error, actual >= lo AND actual <= hi AS in_band FROM m""",
)
def d06(spark, sf_dir):
    p0 = F.col("p0")
    rows = test_bands(spark, sf_dir).select(
        F.col("ticker").cast("string").alias("ticker"),
        "date",
        F.concat(F.col("horizon").cast("string"), F.lit("d")).alias("horizon"),
        "p0",
        (p0 * 1.01).alias("target"),
        (p0 * 0.5).alias("range_lo"),
        (p0 * 1.5).alias("range_hi"),
        F.lit("hold").alias("signal"),
        F.when(F.col("horizon") != 20, p0 * F.exp("y")).alias("actual"),
    )
    out = D.manual_choices(rows)
    return rounded(out, [*KEY, "horizon", "source", "in_band"], 6, ["band_lo_ret", "band_hi_ret", "pct_error"])


@query(
    "d07_batch_summary",
    f"""WITH {DAILY}, {_BANDS}, {_CH} SELECT horizon, count(*) AS n, round(avg(CAST(in_band AS INTEGER)), 6) AS in_band, round(avg(abs(pct_error)), 6) AS mpe FROM sd GROUP BY 1""",
)
def d07(spark, sf_dir):
    """Wide bands per horizon -> one row per horizon -> scored -> summary."""
    tb = test_bands(spark, sf_dir)
    band = F.struct(*D.TAUS)
    wide = tb.groupBy(*KEY, "p0").agg(
        *[F.first(F.when(F.col("horizon") == h, band), ignorenulls=True).alias(f"band{h}") for h in HS],
        *[F.first(F.when(F.col("horizon") == h, F.col("y")), ignorenulls=True).alias(f"r{h}") for h in HS],
    )
    scored_ = D.score(D.choose(D.unpivot_horizons(wide, KEY, HS)))
    return scored_.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("in_band").cast("double")), 6).alias("in_band"),
        F.round(F.avg(F.abs("pct_error")), 6).alias("mpe"),
    )
