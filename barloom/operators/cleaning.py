"""Cleaning, universe filters and calendar alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import DAILY, EPS, Axis, clip
from barloom.operators.blocks import date_positions
from barloom.operators.ranking import kth_smallest, quantiles


def is_dated(df: DataFrame, ax: Axis) -> bool:
    """True when the axis is a DATE, so that a series is bounded by the calendar."""
    return dict(df.dtypes).get(ax.time) == "date"


def drop_zero_volume(df: DataFrame) -> DataFrame:
    return df.filter("volume > 0") if "volume" in df.columns else df


def forward_fill(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = 1, ax: Axis = DAILY
) -> DataFrame:
    """Fill NULLs from the last value of the same ticker, at most ``limit`` rows old."""
    columns = columns or [c for c in df.columns if c not in (*ax.keys, ax.time)]
    w = ax.running() if limit is None else ax.ordered().rowsBetween(-limit, 0)
    return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in columns})


def winsorize(df: DataFrame, column: str, low: float = 0.001, high: float = 0.999, ax: Axis = DAILY) -> DataFrame:
    """Clip to each ticker's own quantiles (linear interpolation)."""
    x = F.col(column)
    if is_dated(df, ax):
        lo = F.percentile(x, F.lit(low)).over(ax.whole())
        hi = F.percentile(x, F.lit(high)).over(ax.whole())
        return df.withColumn(column, clip(x, lo, hi))
    edges = quantiles(df, ax.keys, column, {"__lo": low, "__hi": high})
    joined = df.join(edges, list(ax.keys), "left")
    return joined.withColumn(column, clip(x, F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, missing, pct: one pass, most missing first."""
    columns = list(columns or df.columns)
    one = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return (
        one.unpivot(["__n"], columns, "column_name", "missing")
        .select("column_name", "missing", (F.col("missing") / F.greatest(F.col("__n"), F.lit(1))).alias("pct"))
        .orderBy(F.desc("missing"), "column_name")
    )


def median_impute(df: DataFrame, columns: Sequence[str], by_ticker: bool = True, ax: Axis = DAILY) -> DataFrame:
    """NULLs become the ticker's (or the global) median, then zero."""
    if by_ticker and is_dated(df, ax):
        return df.withColumns(
            {c: F.coalesce(F.col(c), F.median(F.col(c)).over(ax.whole()), F.lit(0.0)) for c in columns}
        )
    for c in columns:
        by = list(ax.keys) if by_ticker else []
        middle = quantiles(df, by, c, {"__median": 0.5})
        if by:
            df = df.join(middle, by, "left")
            df = df.withColumn(c, F.coalesce(F.col(c), F.col("__median"), F.lit(0.0))).drop("__median")
        else:
            df = df.withColumn(c, F.coalesce(F.col(c), middle.scalar(), F.lit(0.0)))
    return df


def drop_stale(df: DataFrame, window: int = 60, least: float = 1e-8, ax: Axis = DAILY) -> DataFrame:
    """Drop tickers whose last ``window`` log returns do not move."""
    last = Window.partitionBy(*ax.keys).orderBy(F.desc(ax.time))
    tail = (
        df.select(*ax.keys, ax.time, ax.log_return(F.col("close")).alias("__r"))
        .withColumn("__age", F.row_number().over(last))
        .filter(F.col("__age") <= window)
    )
    alive = tail.groupBy(*ax.keys).agg(F.stddev_samp("__r").alias("__s")).filter(F.col("__s") > least)
    return df.join(alive, list(ax.keys), "left_semi")


def liquid(df: DataFrame, min_dollar_volume: float, ax: Axis = DAILY) -> DataFrame:
    """Keep tickers whose median close x volume reaches the threshold."""
    value = df.select(*ax.keys, ax.time, (F.col("close") * F.coalesce(F.col("volume"), F.lit(0.0))).alias("__dv"))
    if is_dated(df, ax):
        middle = value.groupBy(*ax.keys).agg(F.median("__dv").alias("__m"))
    else:
        middle = quantiles(value, ax.keys, "__dv", {"__m": 0.5})
    return df.join(middle.filter(F.col("__m") >= min_dollar_volume), list(ax.keys), "left_semi")


def min_history(df: DataFrame, n: int, ax: Axis = DAILY) -> DataFrame:
    """Keep tickers with at least n non-null closes."""
    kept = df.groupBy(*ax.keys).agg(F.count("close").alias("__n")).filter(F.col("__n") >= n)
    return df.join(kept, list(ax.keys), "left_semi")


def date_stride(df: DataFrame, step: int, time: str = "date") -> DataFrame:
    """Rows of every ``step``-th distinct date."""
    kept = date_positions(df, time, "__p").filter(F.col("__p") % step == 0)
    return df.join(kept, time, "left_semi")


def row_stride(df: DataFrame, step: int, ax: Axis = DAILY) -> DataFrame:
    """Every ``step``-th row of each ticker."""
    return df.withColumn("__p", ax.position() - 1).filter(F.col("__p") % step == 0).drop("__p")


def align(keys: DataFrame, values: DataFrame, on: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Values on the given keys; keys without a value get NULL."""
    return keys.join(values, list(on), "left")


def describe(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """count, mean, std, min, max and exact percentiles of each column."""
    long = df.unpivot([], list(columns), "column_name", "value").filter(F.col("value").isNotNull())
    basic = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    points = {f"p{p * 100:g}".replace(".", "_"): p for p in percentiles}
    return basic.join(quantiles(long, ["column_name"], "value", points), "column_name")


def ticker_summary(df: DataFrame, ax: Axis = DAILY) -> DataFrame:
    return df.groupBy(*ax.keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.min(ax.time).alias("first_date"), F.max(ax.time).alias("last_date")
    )


def seeded_draw(keys: Sequence[str], seed: int) -> Column:
    """A uniform 52-bit number that depends on the key and the seed only."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def subsample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (all when fewer), the same on every run.

    The cut-off is the n-th smallest draw, found from value counts, so no task
    holds the sample.
    """
    drawn = df.withColumn("__draw", seeded_draw(keys, seed))
    edge = kth_smallest(drawn, [], "__draw", F.least(F.lit(n), F.col("total")), "__edge").select("__edge")
    return drawn.filter(F.col("__draw") <= edge.scalar()).drop("__draw")


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation of every column."""
    return train.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns], *[F.stddev_pop(c).alias(f"{c}_std") for c in columns]
    )


def standardize(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / (std + 1e-9) with the training statistics."""
    stats = scaler.select(F.struct(*[F.col(c) for c in scaler.columns]).alias("s")).scalar()
    out = df.withColumn("__s", stats)
    s = F.col("__s")
    return out.withColumns(
        {c: (F.col(c) - s[f"{c}_mean"]) / (s[f"{c}_std"] + EPS) for c in columns}
    ).drop("__s")


def recent_dates(df: DataFrame, n: int, time: str = "date") -> DataFrame:
    """Rows of the last n distinct dates."""
    kept = date_positions(df, time, "__p", "__n").filter(F.col("__p") >= F.col("__n") - n)
    return df.join(kept, time, "left_semi")


def coverage_filter(df: DataFrame, share: float = 0.7, value: str = "close", ax: Axis = DAILY) -> DataFrame:
    """Tickers present on at least ``share`` of the dates (rounded down)."""
    dates = df.agg(F.count_distinct(ax.time)).scalar()
    kept = df.groupBy(*ax.keys).agg(F.count(value).alias("__n")).filter(F.col("__n") >= F.floor(dates * share))
    return df.join(kept, list(ax.keys), "left_semi")


def on_calendar(df: DataFrame, value: str, calendar: DataFrame | None = None, ax: Axis = DAILY) -> DataFrame:
    """The value of every ticker on every date of the calendar (NULL where absent).

    The calendar is one array of dates, one entry per day at most, exploded next
    to each ticker.
    """
    days = (df if calendar is None else calendar).agg(F.array_sort(F.collect_set(ax.time))).scalar()
    grid = df.select(*ax.keys).distinct().select(*ax.keys, F.explode(days).alias(ax.time))
    return grid.join(df.select(*ax.keys, ax.time, value), [*ax.keys, ax.time], "left")


def dense_panel(df: DataFrame, share: float = 0.7, value: str = "close", fill_zero: bool = False, ax: Axis = DAILY):
    """Coverage filter, calendar alignment and forward fill.

    Prices then drop the dates some ticker still lacks; volumes take zero.
    """
    kept = coverage_filter(df, share, value, ax)
    filled = forward_fill(on_calendar(kept, value, df, ax), [value], None, ax)
    if fill_zero:
        return filled.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    whole = filled.groupBy(ax.time).agg(F.count_if(F.col(value).isNull()).alias("__gaps")).filter("__gaps = 0")
    return filled.join(whole, ax.time, "left_semi")
