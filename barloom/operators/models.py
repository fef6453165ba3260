"""Model surface on Spark ML: fitting, stacking, blending, drivers, baselines.

Loops here run over folds, seeds or grid values (dozens at most); each step is
a distributed fit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators import metrics as M
from barloom.operators.bootstrap import poisson_one
from barloom.operators.blocks import date_positions
from barloom.operators.cleaning import EPS, fit_scaler, standardize
from barloom.operators.infotheory import mutual_information, names, top_by_information
from barloom.operators.metrics import roc_auc
from barloom.operators.perceptron import BlockPerceptron
from barloom.operators.splits import positional_split, with_roles
from barloom.session import materialize, scratch_path
from barloom.sources import files

VEC = "features_vec"


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VEC).transform(df)


def probability(scored: DataFrame, out: str = "p") -> DataFrame:
    """Probability of class 1 as a plain column."""
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1])


# ---- linear -------------------------------------------------------------------


def elastic_net(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, l1_ratio: float = 0.0) -> Model:
    """Minimise |y - Xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2).

    Spark scales the squared penalty by the label's deviation; the settings undo that.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    spread = df.agg(F.stddev_pop(y)).first()[0] or 1.0
    reg = l1 + l2 * spread
    est = LinearRegression(
        featuresCol=VEC, labelCol=y, regParam=reg, elasticNetParam=(l1 / reg if reg else 0.0),
        standardization=False, maxIter=500, tol=1e-10,
    )
    return est.fit(assembled(df, features))


def ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0) -> Model:
    """Minimise |y - Xw|^2 + alpha |w|^2 with a free intercept."""
    n, spread = df.agg(F.count(F.lit(1)), F.stddev_pop(y)).first()
    est = LinearRegression(
        featuresCol=VEC, labelCol=y, regParam=alpha / n * (spread or 1.0), elasticNetParam=0.0,
        standardization=False, solver="normal",
    )
    return est.fit(assembled(df, features))


def rolling_ridge(
    df: DataFrame, features: Sequence[str], y: str, every: int = 21, window: int = 756, alpha: float = 1.0,
    time: str = "date",
) -> DataFrame:
    """Predictions of a ridge refitted every ``every`` dates on the ``window`` dates before (three years).

    One pass sums products of the columns per bucket of ``every`` dates; a refit adds up its buckets and
    solves a system as small as the features.  There is one row of sums per bucket of the calendar, so the
    solving is done on the driver.  Rows before the first refit, and rows with a missing feature, have no prediction.
    """
    cols = list(features)
    places = materialize(date_positions(df, time, "__p"), "positions")
    placed = df.join(places, time).withColumn("__b", F.floor(F.col("__p") / every))
    pairs = [(a, b) for i, a in enumerate(cols) for b in [*cols[i:], y]]
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in [*cols, y])]
    sums += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs]
    per = placed.dropna("any", subset=[*cols, y]).groupBy("__b").agg(*sums)
    buckets = places.select(F.floor(F.col("__p") / every).alias("__b")).distinct().join(per, "__b", "left")
    past = Window.orderBy("__b").rangeBetween(-(window // every), -1)
    found = buckets.select("__b", *(F.sum(c).over(past).alias(c) for c in per.columns if c != "__b")).filter("n > 0")
    rows = []
    for r in found.collect():
        n = r["n"]
        mean = np.array([r[f"s_{c}"] for c in cols]) / n
        xx, xy = np.zeros((len(cols), len(cols))), np.zeros(len(cols))
        for a, b in pairs:
            i = cols.index(a)
            if b == y:
                xy[i] = r[f"p_{a}_{y}"] - r[f"s_{a}"] * r[f"s_{y}"] / n
            else:
                j = cols.index(b)
                xx[i, j] = xx[j, i] = r[f"p_{a}_{b}"] - r[f"s_{a}"] * r[f"s_{b}"] / n
        w = np.linalg.solve(xx + alpha * np.eye(len(cols)), xy)
        rows.append((r["__b"], float(r[f"s_{y}"] / n - mean @ w), [float(v) for v in w]))
    table = df.sparkSession.createDataFrame(rows, "__b long, __c double, __w array<double>")
    value = F.col("__c")
    for i, c in enumerate(cols):
        value = value + F.col("__w")[i] * F.col(c)
    return placed.join(table, "__b").withColumn("prediction", value).drop("__b", "__p", "__c", "__w")


def logistic(df: DataFrame, features: Sequence[str], y: str, alpha: float = 1.0, weight: str | None = None) -> Model:
    """Logistic regression with C = 1 / alpha; with weights their sum stands for the number of rows."""
    n = df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    est = LogisticRegression(
        featuresCol=VEC, labelCol=y, regParam=max(alpha, 1e-8) / n, elasticNetParam=0.0, standardization=False,
        maxIter=500, tol=1e-10,
    )
    return (est.setWeightCol(weight) if weight else est).fit(assembled(df, features))


def balanced_logistic(df: DataFrame, features: Sequence[str], y: str, c: float = 0.1) -> Model:
    """Logistic regression in which both classes weigh the same, with inverse penalty ``c``."""
    return logistic(balanced_weights(df, y, "__w"), features, y, 1.0 / c, "__w")


def balanced_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """n / (classes * rows of the class)."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.struct(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    table = counts.withColumn("__t", total).select(y, (F.col("__t.n") / (F.col("__t.k") * F.col("__c"))).alias(out))
    return df.join(table, y)


def importance_table(model: Model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """``coefficients``, or no rows for a family that has none (naive Bayes, perceptron)."""
    if not any(hasattr(model, a) for a in ("coefficientMatrix", "coefficients", "featureImportances")):
        return spark.createDataFrame([], "feature string, value double")
    return coefficients(model, features, spark)


def coefficients(model: Model, features: Sequence[str], df: DataFrame | SparkSession) -> DataFrame:
    """feature, value: signed for regressions, mean size over classes for classifiers."""
    if hasattr(model, "coefficientMatrix"):
        m = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        m = model.coefficients.toArray()
    else:
        m = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, m)]
    spark = df if isinstance(df, SparkSession) else df.sparkSession
    return spark.createDataFrame(rows, "feature string, value double")


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("value"), "feature").limit(k)


# ---- naive Bayes ------------------------------------------------------------------


def bayes_table(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """One row per class: prior, and mean and variance (+1e-9) of every feature."""
    stats = df.groupBy(y).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.avg(f).alias(f"{f}_mean") for f in features],
        *[(F.var_pop(f) + 1e-9).alias(f"{f}_var") for f in features],
    )
    return stats.withColumn("prior", F.col("__n") / stats.agg(F.sum("__n")).scalar()).drop("__n")


def bayes_probability(df: DataFrame, table: DataFrame, features: Sequence[str], y: str, out: str = "p") -> DataFrame:
    """Gaussian naive Bayes probability of class 1 (two classes), as column arithmetic."""
    whole = table.agg(F.map_from_entries(F.collect_list(F.struct(F.col(y), F.struct(*table.columns))))).scalar()
    staged = df.withColumn("__t", whole)

    def score(k: int):
        s = F.col("__t")[k]
        out = F.log(s["prior"])
        for f in features:
            v = s[f"{f}_var"]
            gap = F.col(f) - s[f"{f}_mean"]
            out = out - 0.5 * (F.log(2 * math.pi * v) + gap * gap / v)
        return out

    return staged.withColumn(out, 1 / (1 + F.exp(score(0) - score(1)))).drop("__t")


# ---- factory ----------------------------------------------------------------------


def boosted(task: str, label: str, validation: str | None = None, **params: Any) -> Estimator:
    """Gradient boosted trees; ``validation`` names a boolean column for early stopping."""
    common = dict(
        featuresCol=VEC, labelCol=label, maxIter=int(params.get("num_iterations", 1000)),
        stepSize=float(params.get("learning_rate", 0.05)), maxDepth=int(params.get("max_depth", 5)),
        subsamplingRate=float(params.get("bagging_fraction", 0.85)),
        featureSubsetStrategy=str(params.get("feature_fraction", "auto")),
        minInstancesPerNode=int(params.get("min_data_in_leaf", 20)), seed=42,
    )
    est = GBTClassifier(**common) if task == "classification" else GBTRegressor(**common)
    return est.setValidationIndicatorCol(validation) if validation else est


def build_model(config: Mapping[str, Any], task: str, label: str = "label") -> Estimator:
    """Estimator of a family that needs nothing from the data: gbm, random_forest, naive_bayes, mlp."""
    family, params = config["family"], dict(config.get("params", {}))
    if family == "gbm":
        classes, validation = int(params.pop("classes", 2)), params.pop("validation", None)
        est = boosted(task, label, validation, **params)
        return OneVsRest(classifier=est, labelCol=label, featuresCol=VEC) if classes > 2 else est
    if family == "random_forest":
        common = dict(
            featuresCol=VEC, labelCol=label, numTrees=int(params.get("trees", 400)), maxDepth=6,
            minInstancesPerNode=20, seed=42,
        )
        est = RandomForestClassifier(**common) if task == "classification" else RandomForestRegressor(**common)
        return est.setWeightCol(params["weight"]) if params.get("weight") else est
    if family == "naive_bayes":
        return NaiveBayes(featuresCol=VEC, labelCol=label, modelType="gaussian")
    if family == "mlp":
        return BlockPerceptron(
            featuresCol=VEC, labelCol=label, layers=params["layers"], seed=42,
            maxIter=int(params.get("epochs", 200)),
        )
    raise ValueError(f"unknown model family: {family}")


def fit_model(
    config: Mapping[str, Any], task: str, df: DataFrame, features: Sequence[str], label: str, valid: DataFrame | None = None
) -> Model:
    """Fit a family on plain feature columns; the linear ones by their exact objectives.

    ``linear`` is elastic net or logistic with C = 1 / alpha, ``online_linear`` ridge (or the same
    logistic).  ``valid``: later rows, purged by the caller, on which boosting stops early.
    """
    family, params = config["family"], dict(config.get("params", {}))
    alpha = float(params.get("alpha", 1.0))
    if family in ("linear", "online_linear"):
        if task == "classification":
            return logistic(df, features, label, alpha, params.get("weight"))
        if family == "online_linear":
            return ridge(df, features, label, alpha)
        return elastic_net(df, features, label, alpha, float(params.get("l1_ratio", 0.0)))
    if family == "gbm" and valid is not None and int(params.get("classes", 2)) == 2:
        cols = [*features, label]
        marked = df.select(*cols, F.lit(False).alias("__valid")).unionByName(valid.select(*cols, F.lit(True).alias("__valid")))
        config = {"family": family, "params": {**params, "validation": "__valid"}}
        return build_model(config, task, label).fit(assembled(marked, features))
    return build_model(config, task, label).fit(assembled(df, features))


class ColumnScaler(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / (deviation + 1e-9) of columns, as a pipeline stage that is saved with its statistics.

    Adds ``<column>__z`` for every input column; missing values stay missing.
    """

    means = Param(Params._dummy(), "means", "mean of each input column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviation of each input column", TypeConverters.toListFloat)

    @classmethod
    def fitted(cls, df: DataFrame, columns: Sequence[str]) -> ColumnScaler:
        """With the statistics of ``df``, as ``fit_scaler`` gives them."""
        stats = fit_scaler(df, columns).first()
        return cls().setParams(list(columns), [float(stats[f"{c}_mean"]) for c in columns], [float(stats[f"{c}_std"]) for c in columns])

    def setParams(self, columns: list[str], means: list[float], deviations: list[float]) -> ColumnScaler:
        return self._set(inputCols=columns, means=means, deviations=deviations)

    def outputs(self) -> list[str]:
        return [f"{c}__z" for c in self.getInputCols()]

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = zip(self.getInputCols(), self.getOrDefault("means"), self.getOrDefault("deviations"), self.outputs())
        return df.withColumns({out: (F.col(c) - m) / (d + EPS) for c, m, d, out in parts})


def save_checkpoint(features: Sequence[str], model: Model, path: str, scaler: ColumnScaler | None = None) -> None:
    """Scaler (if any), assembler and model as one pipeline on disk.

    A model fitted on standardised columns is saved with the ``scaler`` that made them, so the
    loaded pipeline takes plain columns.
    """
    inputs = scaler.outputs() if scaler else list(features)
    stages = [*([scaler] if scaler else []), VectorAssembler(inputCols=inputs, outputCol=VEC), model]
    PipelineModel(stages).write().overwrite().save(path)


def load_checkpoint(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- stacking and blending ------------------------------------------------------


def _branches(
    features: Sequence[str], sentiment: Sequence[str], epochs: int, hidden: Sequence[int]
) -> dict[str, tuple[list[str], str, dict[str, Any]]]:
    """Branch name -> (columns, family, parameters)."""
    layers = [len(features), *hidden, 2]
    out = {
        "lr": (list(features), "linear", {}),
        "nb": (list(features), "naive_bayes", {}),
        "mlp": (list(features), "mlp", {"layers": layers, "epochs": epochs}),
    }
    return out | ({"sent": (list(sentiment), "linear", {})} if sentiment else {})


def _scored(fit_on: DataFrame, apply_to: DataFrame, y: str, branches: Mapping[str, tuple[list[str], str, dict[str, Any]]]) -> DataFrame:
    """``apply_to`` with ``p_<branch>`` columns from branches fitted on ``fit_on``; a missing sentiment counts as 0."""
    out = apply_to
    for name, (cols, family, params) in branches.items():
        fit_rows, rows = (d.fillna(0.0, cols) if name == "sent" else d for d in (fit_on, out))
        scaler = ColumnScaler.fitted(fit_rows, cols)
        z = scaler.outputs()
        fit_rows = scaler.transform(fit_rows.select(*cols, y).dropna())
        model = fit_model({"family": family, "params": params}, "classification", fit_rows, z, y)
        rows = probability(model.transform(assembled(scaler.transform(rows), z)), f"p_{name}")
        out = rows.drop(*z, VEC, "rawPrediction", "probability", "prediction")
    return out


def out_of_fold(
    df: DataFrame, features: Sequence[str], y: str, time: str = "date", folds: int = 5, purge: int = 1,
    sentiment: Sequence[str] = (), epochs: int = 200, hidden: Sequence[int] = (128, 64), threads: int = 4,
) -> DataFrame:
    """``df`` with a score per branch that was fitted on other dates, and the block of dates (``fold``).

    Dates fall into ``folds`` consecutive blocks of about equal numbers.  The branches that score a
    block are fitted on all dates but the block and ``purge`` dates on both sides of it, whose labels
    overlap with its own.  Rows are written once with their date position, every fold filters that
    table, and folds are fitted side by side.  Rows with a missing feature go.
    """
    placed = df.dropna("any", subset=[*features, y]).join(date_positions(df, time, "__p", "__n"), time)
    # In a fixed order, so that a rerun hands the optimizers the same rows in the same order.
    rows = materialize(placed.sortWithinPartitions(time, *features, y), "out-of-fold")
    n = rows.agg(F.max("__n")).first()[0] or 0
    branches = _branches(features, sentiment, epochs, hidden)
    edges = [n * k // folds for k in range(folds + 1)]

    def one(k: int) -> DataFrame:
        low, high = edges[k], edges[k + 1]
        own = (F.col("__p") >= low) & (F.col("__p") < high)
        others = (F.col("__p") < low - purge) | (F.col("__p") >= high + purge)
        scored = _scored(rows.filter(others), rows.filter(own), y, branches)
        return scored.withColumn("fold", F.lit(k)).drop("__p", "__n")

    used = [k for k in range(folds) if edges[k] < edges[k + 1]]
    if not used:
        raise ValueError("no complete rows to fit on")
    with ThreadPool(min(threads, len(used))) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), used)
    return reduce(DataFrame.unionByName, parts)


def stacked(
    train: DataFrame, test: DataFrame, features: Sequence[str], y: str, time: str = "date", epochs: int = 200,
    hidden: Sequence[int] = (128, 64), purge: int = 1, folds: int = 5, sentiment: Sequence[str] = (), threads: int = 4,
) -> DataFrame:
    """Logistic, naive Bayes, perceptron and (given ``sentiment`` columns) sentiment branches under a logistic meta model.

    The meta model learns on scores that no branch fitted on the same dates gave (``out_of_fold``),
    over all training dates; then the branches are refitted on all of them and score ``test``.
    """
    inner = out_of_fold(train, features, y, time, folds, purge, sentiment, epochs, hidden, threads)
    branches = _branches(features, sentiment, epochs, hidden)
    cols = [f"p_{n}" for n in branches]
    meta = logistic(materialize(inner.select(*cols, y), "stack-meta"), cols, y, 1.0)
    whole = materialize(train.dropna("any", subset=[*features, y]), "stack-train")
    scored = _scored(whole, test.dropna("any", subset=list(features)), y, branches)
    return probability(meta.transform(assembled(scored, cols))).drop(VEC, "rawPrediction", "probability")


def fit_blend(df: DataFrame, y: str, p1: str, p2: str, steps: int = 20) -> DataFrame:
    """The weight a of a*p1 + (1-a)*p2 with the best AUC (one row: a, auc).

    The grid is an array exploded next to each row; ties take the smallest a.
    AUCs are compared to 12 digits so that float noise cannot break a tie.
    """
    grid = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i / steps).alias("a")) for i in range(steps + 1)])
    rows = df.select(y, p1, p2, F.explode(grid).alias("g")).select(
        y, F.col("g.i").alias("i"), (F.col("g.a") * F.col(p1) + (1 - F.col("g.a")) * F.col(p2)).alias("s")
    )
    scores = roc_auc(rows, y, "s", ["i"])
    best = F.max_by(F.struct("i", "auc"), F.struct(F.round("auc", 12), -F.col("i"))).alias("b")
    return scores.agg(best).select((F.col("b.i") / float(steps)).alias("a"), F.col("b.auc").alias("auc"))


def nearest_branch(windows: Sequence[int], horizon: int) -> int:
    """Index of the horizon, or of the closest one."""
    return min(range(len(windows)), key=lambda i: abs(windows[i] - horizon))


# ---- drivers ---------------------------------------------------------------------


class FoldStore:
    """Models, importances and reports of the folds of a walk-forward run, in one folder.

    ``models/fold=k`` holds the checkpoint, ``importances/fold=k`` and ``reports/fold=k`` tables.  The
    report is written last and its success mark makes a fold complete, so a run that was killed
    is taken up where it stopped.  The settings are kept too: a folder never mixes two runs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, kind: str, fold: int) -> str:
        return f"{self.path}/{kind}/fold={fold}"

    def begin(self, settings: Mapping[str, Any]) -> None:
        text, place = json.dumps(settings, sort_keys=True, default=str), f"{self.path}/settings.json"
        if files.exists(place):
            if files.read(place) != text:
                raise ValueError(f"{self.path} holds folds of other settings")
        else:
            files.write(place, text)

    def complete(self, fold: int) -> bool:
        return files.exists(f"{self._at('reports', fold)}/_SUCCESS")

    def save(self, fold: int, features: Sequence[str], model: Model, importances: DataFrame, report: DataFrame) -> None:
        save_checkpoint(features, model, self._at("models", fold))
        importances.write.mode("overwrite").parquet(self._at("importances", fold))
        report.write.mode("overwrite").parquet(self._at("reports", fold))

    def model(self, fold: int) -> PipelineModel:
        """The fold's model behind its assembler: takes plain columns."""
        return load_checkpoint(self._at("models", fold))

    def importances(self) -> DataFrame:
        """(feature, value, fold)"""
        return self.spark.read.parquet(f"{self.path}/importances")

    def reports(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/reports")


def train_walk_forward(
    df: DataFrame, features: Sequence[str], y: str, roles: DataFrame, config: Mapping[str, Any], task: str,
    time: str = "date", store: str | None = None,
) -> DataFrame:
    """One fit per fold; a row per fold with row counts and the report of the task.

    Boosting stops early on the fold's ``val`` rows.  Each fold filters the same rows, no copy
    per fold is made.  With ``store`` (a folder) every fold's model, importances and report
    are kept, and folds that are complete there are not fitted again.  Folds
    without training or test rows are left out.
    """
    spark = df.sparkSession
    kept = FoldStore(spark, store or scratch_path(spark, "folds"))
    kept.begin({"features": list(features), "y": y, "config": dict(config), "task": task})
    data = with_roles(materialize(df.select(time, *features, y).dropna(), "walk-forward"), roles, time)
    sizes = data.groupBy("fold").pivot("role", ["train", "val", "test"]).count().fillna(0).orderBy("fold").collect()
    for fold, n_train, n_val, n_test in sizes:
        if not n_train or not n_test or kept.complete(fold):
            continue
        part = data.filter(F.col("fold") == fold)
        train, test = part.filter("role = 'train'"), part.filter("role = 'test'")
        model = fit_model(config, task, train, features, y, part.filter("role = 'val'") if n_val else None)
        scored = model.transform(assembled(test, features))
        if task == "classification":
            report = M.classification_report(probability(scored), y, "prediction", "p")
        else:
            report = M.regression_report(scored, y, "prediction")
        report = report.select(F.lit(n_train).alias("n_train"), F.lit(n_test).alias("n_test"), "*")
        kept.save(fold, features, model, importance_table(model, features, spark), report)
    found = kept.reports()
    return found.select("fold", *(c for c in found.columns if c != "fold"))


def transfer_evaluate(
    source: DataFrame, target: DataFrame, features: Sequence[str], y: str, config: Mapping[str, Any], fraction: float = 0.5,
    task: str = "regression",
) -> DataFrame:
    """Report of the task on the target's later part: source model as is, and refitted on the earlier part."""
    parts = positional_split(target.dropna("any", subset=[*features, y]), fraction)
    first, tail = parts.filter("first_part"), parts.filter(~F.col("first_part"))
    rows = []
    for name, fit_on in (("zero_shot", source.dropna("any", subset=[*features, y])), ("fine_tuned", first)):
        scored = fit_model(config, task, fit_on, features, y).transform(assembled(tail, features))
        if task == "classification":
            report = M.classification_report(probability(scored), y, "prediction", "p")
        else:
            report = M.regression_report(scored, y, "prediction")
        rows.append(report.select(F.lit(name).alias("mode"), "*"))
    return rows[0].unionByName(rows[1])


def common_columns(a: DataFrame, b: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    return [c for c in a.columns if c in b.columns and c not in drop]


def persistence_baseline(
    df: DataFrame, y: str, columns: Sequence[str], roles: DataFrame, ref: str = "vol252", time: str = "date"
) -> DataFrame:
    """Test AUC of one trailing column taken as the score (feature, auc)."""
    if ref not in columns:
        ref = next(c for c in columns if c.startswith("vol"))
    test = df.join(roles.filter("role = 'test'"), time, "left_semi")
    return roc_auc(test, y, ref).select(F.lit(ref).alias("feature"), "auc")


def signal_probe(df: DataFrame, features: Sequence[str], y: str, roles: DataFrame, time: str = "date") -> DataFrame:
    """Holdout accuracy of a logistic fit against the trivial baseline, with input and output information."""
    data = with_roles(df, roles, time)
    train, test = data.filter("role = 'train'"), data.filter("role = 'test'")
    scaler = fit_scaler(train, features)
    model = logistic(standardize(train, scaler, features), features, y, 1e-6)
    scored = probability(model.transform(assembled(standardize(test, scaler, features), features)))
    one = scored.agg(
        F.avg(((F.col("p") >= 0.5) == (F.col(y) == 1)).cast("double")).alias("accuracy"),
        M.majority_baseline(F.col(y)).alias("baseline"),
    )
    best = mutual_information(scored, features, y).agg(F.max("mi")).scalar()
    output = mutual_information(scored, ["p"], y).select("mi").scalar()
    return one.select("accuracy", "baseline", (F.col("accuracy") - F.col("baseline")).alias("gain"), best.alias("best_input_mi"), output.alias("output_mi"))


def recent_importance(
    df: DataFrame, features: Sequence[str], y: str, k: int, recent: DataFrame, method: str = "trees", rounds: int = 100
) -> DataFrame:
    """Top-k features: by boosted-tree importance on recent dates, or (``information``) by mutual information on all.

    Short histories have too few recent rows for trees; the caller says so by ``method``.
    """
    if method == "information":
        return top_by_information(df, features, y, k).select("feature", F.col("mi").alias("value"))
    if method != "trees":
        raise ValueError("method must be trees or information")
    part = df.join(recent, "date", "left_semi")
    model = boosted("classification", y, num_iterations=rounds).fit(assembled(part, features))
    return top_features(coefficients(model, features, df), k)


def lasso_overlap(df: DataFrame, features: Sequence[str], y: str, lam: float = 5000.0, k: int = 6) -> DataFrame:
    """feature, ridge and lasso coefficients, and whether each selection keeps it."""
    n = df.count()
    z = standardize(df, fit_scaler(df, features), features)
    r = coefficients(elastic_net(z, features, y, lam / n, 0.0), features, df).withColumnRenamed("value", "ridge")
    s = coefficients(elastic_net(z, features, y, lam / n, 1.0), features, df).withColumnRenamed("value", "lasso")
    top_l1 = names(top_features(s.select("feature", F.abs("lasso").alias("value")), k))
    top_mi = names(top_by_information(df, features, y, k))
    f = F.col("feature")
    return r.join(s, "feature").withColumns({"in_lasso": f.isin(top_l1), "in_mi": f.isin(top_mi)})


def bias_variance(
    train: DataFrame, test: DataFrame, features: Sequence[str], y: str, keys: Sequence[str], rounds: int = 20, seed: int = 0
) -> DataFrame:
    """Variance, squared bias, noise and total squared error over bootstrap fits.

    A bootstrap sample weighs each row by a Poisson(1) draw from a hash of its key, so
    it does not depend on how the rows are partitioned.
    """
    scaler = fit_scaler(train, features)
    a = materialize(assembled(standardize(train, scaler, features), features).select(*keys, y, VEC), "bias-train")
    b = materialize(assembled(standardize(test, scaler, features), features).select(*keys, y, VEC), "bias-test")
    runs = b.select(*keys, F.col(y).cast("double").alias("y"), VEC)
    for i in range(rounds):
        est = LogisticRegression(featuresCol=VEC, labelCol=y, maxIter=50, standardization=False, weightCol="__w")
        u = F.pmod(F.xxhash64(*keys, F.lit(seed + i)), F.lit(1 << 40)) / float(1 << 40)
        model = est.fit(a.withColumn("__w", poisson_one(u).cast("double")).filter("__w > 0"))
        model.setRawPredictionCol("").setPredictionCol("").setProbabilityCol(f"__p{i}")
        runs = model.transform(runs)
    # The scores of all rounds lie side by side in a row, which is shuffled once.
    scores = F.array(*[vector_to_array(F.col(f"__p{i}"))[1] for i in range(rounds)])
    runs = runs.select(*keys, "y", F.explode(scores).alias("p"))
    rows = runs.groupBy(*keys, "y").agg(
        F.avg("p").alias("m"), F.var_pop("p").alias("v"), F.avg((F.col("p") - F.col("y")) ** 2).alias("t")
    )
    noise = F.avg("y") * (1 - F.avg("y"))
    return rows.agg(
        F.avg("v").alias("variance"),
        F.greatest(F.avg((F.col("m") - F.col("y")) ** 2) - noise, F.lit(0.0)).alias("bias2"),
        noise.alias("noise"),
        F.avg("t").alias("total"),
    )


def pipeline(features: Sequence[str], estimator: Estimator) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol=VEC), estimator])
