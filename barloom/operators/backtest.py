"""Backtest series.  Running values are added up per chunk of time first, then inside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import TRADING_DAYS, null_if_zero, ratio
from barloom.operators.blocks import CHUNK, time_chunk
from barloom.operators.ranking import quantiles


def _running(df: DataFrame, values: dict[str, Column], agg: Callable, time: str) -> DataFrame:
    """Add running aggregates along ``time`` as (before, inside): of the chunks of time before, and inside the chunk.

    Only one row per chunk goes through a window without partitions.
    """
    staged = df.withColumns({**{f"__v_{k}": v for k, v in values.items()}, CHUNK: time_chunk(df, time)})
    along = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = staged.groupBy(CHUNK).agg(*(agg(f"__v_{k}").alias(f"__t_{k}") for k in values))
    totals = totals.select(CHUNK, *(agg(f"__t_{k}").over(along).alias(f"__b_{k}") for k in values))
    inside = Window.partitionBy(CHUNK).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    found = staged.join(totals, CHUNK)
    return found.select(*df.columns, *(F.struct(F.col(f"__b_{k}").alias("before"), agg(f"__v_{k}").over(inside).alias("inside")).alias(k) for k in values))


def equity_curve(returns: DataFrame, r: str, initial: float = 1.0, time: str = "date") -> DataFrame:
    """Adds ``equity``: initial * prod(1 + r); a missing return counts as 0."""
    parts = _running(returns, {"__e": 1.0 + F.coalesce(F.col(r), F.lit(0.0))}, F.product, time)
    return parts.withColumn("equity", initial * F.coalesce(F.col("__e.before"), F.lit(1.0)) * F.col("__e.inside")).drop("__e")


def sharpe_ratio(returns: DataFrame, r: str, periods: int = TRADING_DAYS) -> DataFrame:
    return returns.agg(
        (F.sqrt(F.lit(float(periods))) * ratio(F.avg(r), null_if_zero(F.stddev_samp(r)))).alias("sharpe")
    )


def long_short_returns(
    pred: DataFrame,
    prediction: str = "prediction",
    realized: str = "y_logret_h1",
    quantile: float = 0.2,
    least: int = 5,
    time: str = "date",
) -> DataFrame:
    """Per date: mean outcome of the top share minus the bottom share; dates with fewer than ``least`` names are left out."""
    p = F.col(prediction)
    cuts = quantiles(pred, [time], prediction, {"__hi": 1.0 - quantile, "__lo": quantile})
    staged = pred.join(cuts, time)
    legs = staged.groupBy(time).agg(
        F.count(F.lit(1)).alias("__n"),
        F.avg(F.when(p >= F.col("__hi"), F.col(realized))).alias("__long"),
        F.avg(F.when(p <= F.col("__lo"), F.col(realized))).alias("__short"),
    )
    return legs.filter(F.col("__n") >= least).select(time, (F.col("__long") - F.col("__short")).alias("ls_return"))


def strategy_vs_hold(returns: DataFrame, r: str, pred: str, time: str = "date") -> DataFrame:
    """Adds cumulative simple returns of following the 0/1 call and of holding."""
    side = 2 * F.col(pred) - 1
    parts = _running(returns, {"strategy": F.col(r) * side, "buy_hold": F.col(r)}, F.sum, time)

    def total(name: str) -> Column:
        before, inside = F.col(f"{name}.before"), F.col(f"{name}.inside")
        return F.exp(F.when(before.isNotNull() | inside.isNotNull(), F.coalesce(before, F.lit(0.0)) + F.coalesce(inside, F.lit(0.0)))) - 1

    return parts.withColumns({"strategy": total("strategy"), "buy_hold": total("buy_hold")})
