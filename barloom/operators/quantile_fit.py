"""Linear quantile regression for bands, fitted by majorisation.

The pinball loss is majorised by a quadratic that touches it at the current residuals, so a
step is one weighted least-squares system per level and never raises the loss.  The sums of all
levels come from one map-side aggregate over the rows; only they reach the driver, and their
size depends on the number of features alone.  Levels are fitted apart, so predicted
edges may cross; they are put in order row by row, which cannot raise the loss.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.bands import TAUS
from barloom.operators.metrics import pinball
from barloom.session import materialize


@dataclass(frozen=True)
class QuantileModel:
    """Levels by name, features, and per level the intercept followed by the coefficients."""

    taus: Mapping[str, float]
    features: tuple[str, ...]
    weights: np.ndarray
    steps: int

    def raw(self, level: str) -> Column:
        """The level's own linear predictor, before levels are put in order."""
        b, *w = (float(v) for v in self.weights[list(self.taus).index(level)])
        out = F.lit(b)
        for c, k in zip(self.features, w):
            out = out + F.col(c) * k
        return out

    def bands(self, df: DataFrame) -> DataFrame:
        """Add a column per level, ascending within each row; NULL where a feature is missing."""
        whole = F.lit(True)
        for c in self.features:
            whole = whole & F.col(c).isNotNull()
        names = sorted(self.taus, key=self.taus.get)
        edges = F.when(whole, F.array_sort(F.array(*(self.raw(n) for n in names))))
        staged = df.withColumn("__edges", edges)
        return staged.select(*(c for c in df.columns if c not in names), *(F.get("__edges", i).alias(n) for i, n in enumerate(names)))

    def loss(self, df: DataFrame, y: str) -> DataFrame:
        """(level, pinball): mean loss of the ordered edges on rows with an outcome."""
        scored = self.bands(df)
        one = scored.agg(*(pinball(F.col(y), F.col(n), t).alias(n) for n, t in self.taus.items()))
        return one.unpivot([], list(self.taus), "level", "pinball")


def _systems(data: DataFrame, beta: np.ndarray, levels: np.ndarray, smooth: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The least-squares system of every level at ``beta``; a task adds up its rows and hands on the sums only.

    The sums are taken by matrix products in the tasks: with coefficients written into
    expressions Spark would compile new code for every step.
    """
    k = beta.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((len(levels), k, k)), np.zeros((len(levels), k))
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            x, y = np.column_stack(cols[:-1]), cols[-1]
            for t, tau in enumerate(levels):
                near = 1 / (smooth + np.abs(y - x @ beta[t]))
                left[t] += (x * near[:, None]).T @ x
                right[t] += (near * y + 2 * tau - 1) @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([left.ravel(), right.ravel()])])], names=["sums"])

    parts = data.mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("at", "sum"))
    found = np.zeros(len(levels) * k * (k + 1))
    for at, value in parts.groupBy("at").agg(F.sum("sum")).collect():
        found[at] = value
    lefts, rights = np.split(found, [len(levels) * k * k])
    return list(zip(lefts.reshape(len(levels), k, k), rights.reshape(len(levels), k)))


def fit_quantiles(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    taus: Mapping[str, float] = TAUS,
    steps: int = 60,
    tolerance: float = 1e-7,
    smooth: float = 1e-3,
) -> QuantileModel:
    """Fit all levels on the rows without a missing feature or outcome.

    ``smooth``: residuals below this share of the outcome's deviation are weighed alike.  Stops
    when no coefficient, in deviations, moves by more than ``tolerance``.  Constant features
    get 0; an outcome of one value is every level; without rows there is nothing to fit, which raises.
    """
    cols = list(features)
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in [*cols, y])).dropna()
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *(f(c).alias(f"{k}_{c}") for c in [*cols, y] for k, f in (("m", F.avg), ("s", F.stddev_pop))),
    ).first()
    if not stats["n"]:
        raise ValueError("no complete rows to fit quantiles on")
    used = [c for c in cols if stats[f"s_{c}"] > 0]
    scale = stats[f"s_{y}"] or 1.0
    scaled = [((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(f"z{i + 1}") for i, c in enumerate(used)]
    data = materialize(rows.select(F.lit(1.0).alias("z0"), *scaled, ((F.col(y) - stats[f"m_{y}"]) / scale).alias("y")), "quantile-rows")
    levels, k = np.array(list(taus.values())), len(used) + 1
    beta, turn = np.zeros((len(levels), k)), 0
    for turn in range(1, steps + 1 if stats[f"s_{y}"] else 1):
        moved = np.stack([np.linalg.lstsq(left, right, rcond=1e-12)[0] for left, right in _systems(data, beta, levels, smooth)])
        change, beta = float(np.abs(moved - beta).max()), moved
        if change <= tolerance:
            break
    weights = np.zeros((len(levels), len(cols) + 1))
    for i, c in enumerate(used):
        weights[:, cols.index(c) + 1] = beta[:, i + 1] * scale / stats[f"s_{c}"]
    weights[:, 0] = beta[:, 0] * scale + stats[f"m_{y}"] - weights[:, 1:] @ np.array([stats[f"m_{c}"] for c in cols])
    return QuantileModel(dict(taus), tuple(cols), weights, turn)
