"""Forward-looking labels.  Only rows after the current one are read."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import DAILY, TRADING_DAYS, Axis, cut, ratio
from barloom.functions.rolling import Roll, with_rolling
from barloom.operators.ranking import quantiles, with_ranks


def direction(df: DataFrame, horizon: int = 1, ax: Axis = DAILY) -> DataFrame:
    """y_binary_h{h}: 1 when the price is higher h rows later, NULL at the end."""
    later = ax.lead(F.col("close"), horizon)
    return df.withColumn(f"y_binary_h{horizon}", (later > F.col("close")).cast("int"))


def forward_return(horizon: int, ax: Axis = DAILY) -> Column:
    return F.log(ax.lead(F.col("close"), horizon)) - F.log(F.col("close"))


def forward_returns(df: DataFrame, horizons: Sequence[int], prefix: str = "y_logret_h", ax: Axis = DAILY) -> DataFrame:
    return df.withColumns({f"{prefix}{h}": forward_return(h, ax) for h in horizons})


def quantile_targets(df: DataFrame, horizons: Sequence[int], ax: Axis = DAILY) -> DataFrame:
    return forward_returns(df, horizons, "y_quantile_h", ax)


def sequence_targets(df: DataFrame, horizons: Sequence[int], ax: Axis = DAILY) -> DataFrame:
    return forward_returns(df, horizons, "y_seq_h", ax)


def regime_class(
    df: DataFrame,
    horizon: int = 5,
    thresholds: tuple[float, float] = (-0.005, 0.005),
    vol_buckets: tuple[float, ...] = (0.15, 0.30),
    n_buckets: int | None = None,
    ax: Axis = DAILY,
) -> DataFrame:
    """Direction (0/1/2) times a multiplier plus the forward volatility bucket.

    The default multiplier is the number of edges, so neighbouring classes can
    share a number; ``n_buckets=len(vol_buckets)+1`` keeps them apart.
    """
    change = ratio(F.col("close"), ax.lag(F.col("close"))) - 1
    staged = df.withColumns({"__pc": change, "__fwd": forward_return(horizon, ax)})
    ahead = ax.leading(horizon)
    vol = F.when(F.count("__pc").over(ahead) == horizon, F.stddev_samp("__pc").over(ahead))
    bucket = cut(vol * F.lit(math.sqrt(TRADING_DAYS)), vol_buckets)
    way = F.when(F.col("__fwd") > thresholds[1], 2).when(F.col("__fwd") < thresholds[0], 0).otherwise(1)
    out = way * (n_buckets or len(vol_buckets)) + bucket
    return staged.withColumn(f"y_regime_h{horizon}", out.cast("double")).drop("__pc", "__fwd")


def top_bottom_by_count(
    df: DataFrame,
    fwd: str,
    top: float = 0.3,
    bottom: float = 0.3,
    out: str = "y_cs_quantile",
    time: str = "date",
) -> DataFrame:
    """1 for the best round(n*top) names of a date, 0 for the worst; the rest NULL.

    n counts the names without a forward return too; at least one name each.
    """
    ranked = with_ranks(df, [time], {"__rank": fwd}, pct=False)
    ranked = ranked.join(ranked.groupBy(time).agg(F.count(F.lit(1)).alias("__n")), time)
    n_top = F.greatest(F.lit(1.0), F.bround(F.col("__n") * F.lit(top)))
    n_bottom = F.greatest(F.lit(1.0), F.bround(F.col("__n") * F.lit(bottom)))
    label = F.when(F.col("__rank") > F.col("__n") - n_top, 1.0).when(F.col("__rank") <= n_bottom, 0.0)
    return ranked.withColumn(out, label).drop("__rank", "__n")


def split_by_rank(rank: Column, top: float, bottom: float) -> Column:
    """0 at or below ``bottom``, 1 at or above 1 - ``top``, NULL between."""
    return F.when(rank <= bottom, 0).when(rank >= 1.0 - top, 1)


def top_bottom_by_rank(
    df: DataFrame,
    fwd: str,
    top: float = 0.2,
    bottom: float = 0.2,
    out: str = "label",
    time: str = "date",
) -> DataFrame:
    ranked = with_ranks(df, [time], {"__rank": fwd})
    return ranked.withColumn(out, split_by_rank(F.col("__rank"), top, bottom)).drop("__rank")


def forward_volatility(r1: Column, horizon: int, ax: Axis = DAILY) -> Column:
    """Sample deviation of the next ``horizon`` returns; one return has none: NULL."""
    ahead = ax.leading(horizon)
    return F.when(F.count(r1).over(ahead) == horizon, F.stddev_samp(r1).over(ahead))


def volatility_targets(df: DataFrame, horizons: Sequence[int], ax: Axis = DAILY, returns: bool = False) -> DataFrame:
    """h{k}: forward volatility, and r{k}: forward log return when asked."""
    staged = df.withColumn("__r1", ax.log_return(F.col("close")))
    # The deviation of the next h returns is the trailing one, h rows later.
    long = [h for h in horizons if h > 1]
    staged = with_rolling(staged, ax, {f"__v{h}": Roll("std", "__r1", h) for h in long})
    cols = {f"h{h}": ax.lead(F.col(f"__v{h}"), h) for h in long}
    cols |= {f"h{h}": F.abs(ax.lead(F.col("__r1"), 1)) for h in horizons if h <= 1}
    if returns:
        cols |= {f"r{h}": forward_return(h, ax) for h in horizons}
    return staged.withColumns(cols).drop("__r1", *[f"__v{h}" for h in long])


def rank_split(rank: Column, label_pct: float) -> Column:
    """Median split at 0.5, or the two tails below 0.5; NULL rank gives NULL."""
    if label_pct < 0.5:
        return F.when(rank <= label_pct, 0.0).when(rank >= 1.0 - label_pct, 1.0)
    return F.when(rank.isNotNull(), (rank >= 0.5).cast("double"))


def volatility_labels(
    df: DataFrame,
    horizons: Sequence[int],
    label_pct: float = 0.5,
    time: str = "date",
) -> DataFrame:
    """y{k}: which side of the date's volatility split the row is on."""
    ranked = with_ranks(df, [time], {f"__k{h}": f"h{h}" for h in horizons})
    out = ranked.withColumns({f"y{h}": rank_split(F.col(f"__k{h}"), label_pct) for h in horizons})
    return out.drop(*[f"__k{h}" for h in horizons])


def above_median(
    df: DataFrame, fwd: str, out: str = "y_cs", time: str = "date"
) -> DataFrame:
    """1 when the forward return beats the date's median."""
    staged = df.join(quantiles(df, [time], fwd, {"__med": 0.5}), time, "left")
    return staged.withColumn(out, (F.col(fwd) > F.col("__med")).cast("int")).drop("__med")


def mean_by_horizon(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """horizon, mean_vol: the shape of the volatility term structure."""
    one = df.agg(*[F.avg(f"h{h}").alias(str(h)) for h in horizons])
    long = one.unpivot([], [str(h) for h in horizons], "horizon", "mean_vol")
    return long.select(F.col("horizon").cast("int").alias("horizon"), "mean_vol")


# ---- within the day -----------------------------------------------------------


def within_day_targets(df: DataFrame, horizons: Sequence[int], ax: Axis, day: str = "day") -> DataFrame:
    """h{k}, r{k} over bars; NULL when the last bar falls on another day."""
    staged = df.withColumn("__r1", F.coalesce(ax.log_return(F.col("close")), F.lit(0.0)))
    # As in ``volatility_targets``: the deviation of the next h returns is the trailing one, h rows later.
    long = [h for h in horizons if h > 1]
    staged = with_rolling(staged, ax, {f"__v{h}": Roll("std", "__r1", h) for h in long})
    cols = {}
    for h in horizons:
        same = ax.lead(F.col(day), h) == F.col(day)
        ahead = ax.lead(F.col(f"__v{h}"), h) if h > 1 else F.abs(ax.lead(F.col("__r1"), 1))
        cols[f"h{h}"] = F.when(same, ahead)
        cols[f"r{h}"] = F.when(same, forward_return(h, ax))
    return staged.withColumns(cols).drop("__r1", *[f"__v{h}" for h in long])
