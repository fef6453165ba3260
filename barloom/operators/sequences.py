"""Look-back sequences as array columns; a row carries at most one window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import DAILY, Axis

T_MAX = 20  # fixed value: most steps per sequence
WINDOWS = (1, 5, 10, 30, 90, 180)  # fixed value: look-backs in rows


def step(features: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def lookback_sequences(
    df: DataFrame, features: Sequence[str], lookback: int = 20, ax: Axis = DAILY, out: str = "seq"
) -> DataFrame:
    """The previous ``lookback`` feature vectors, without the current row.

    Rows with less history are dropped.
    """
    past = ax.ordered().rowsBetween(-lookback, -1)
    staged = df.withColumn(out, F.collect_list(step(features)).over(past))
    return staged.filter(F.size(out) == lookback)


def sample_window(
    df: DataFrame, features: Sequence[str], w: int, t_max: int = T_MAX, ax: Axis = DAILY, out: str = "seq"
) -> DataFrame:
    """The last w rows up to the current one, thinned evenly to t_max steps.

    Shorter history is padded on the left with its first row.
    """
    steps = F.collect_list(step(features)).over(ax.trailing(w))
    staged = df.withColumn("__a", steps)
    a, n = F.col("__a"), F.size("__a")
    pad = F.concat(F.array_repeat(F.get(a, F.lit(0)), t_max - n), a)
    gaps = max(t_max - 1, 1)
    pick = F.transform(
        F.sequence(F.lit(0), F.lit(t_max - 1)),
        lambda i: F.get(a, F.bround(i * ((n - 1) / F.lit(float(gaps))), 0).cast("int")),
    )
    return staged.withColumn(out, F.when(n <= t_max, pad).otherwise(pick)).drop("__a")


def offsets(w: int, t_max: int = T_MAX) -> list[int]:
    """Rows back of every kept step of a full window of w rows, oldest first."""
    t = min(w, t_max)
    if t == 1:
        return [w - 1] if w == 1 else [0]
    return [w - 1 - round(i * ((w - 1) / (t - 1))) for i in range(t)]


def multiscale_sequences(
    df: DataFrame,
    features: Sequence[str],
    windows: Sequence[int] = WINDOWS,
    t_max: int = T_MAX,
    ax: Axis = DAILY,
    drop_short: bool = True,
) -> DataFrame:
    """seq{w} per window; only the kept steps are read, one ``lag`` each.

    The first max(windows) rows of a series have no full history and are dropped.
    """
    staged = df.withColumn("__step", step(features))
    cols: dict[str, Column] = {}
    for w in windows:
        cols[f"seq{w}"] = F.array(*[ax.lag(F.col("__step"), k) if k else F.col("__step") for k in offsets(w, t_max)])
    if drop_short:
        cols["__pos"] = ax.position()
    staged = staged.withColumns(cols).drop("__step")
    return staged.filter(F.col("__pos") > max(windows)).drop("__pos") if drop_short else staged


def append_scalar(
    df: DataFrame, sequences: Sequence[str], scalar: str, train: Column, min_coverage: float = 0.02
) -> DataFrame:
    """Add a scalar to every step, unless it is (almost) absent from the training rows.

    Missing counts as 0; coverage is the share of non-zero training rows.
    """
    s = F.coalesce(F.col(scalar).cast("double"), F.lit(0.0))
    coverage = df.agg(F.avg(F.when(train, (s != 0).cast("double")))).scalar()
    enough = coverage >= min_coverage
    return df.withColumns(
        {
            q: F.when(enough, F.transform(F.col(q), lambda v: F.concat(v, F.array(s)))).otherwise(F.col(q))
            for q in sequences
        }
    )


def day_context(rows: DataFrame, context: DataFrame, ts: str = "ts", key: str = "ticker", zone: str | None = None):
    """Give timestamped rows the context of their trading day.

    ``zone`` converts UTC timestamps to exchange-local days first.
    """
    local = F.col(ts) if zone is None else F.from_utc_timestamp(F.col(ts), zone)
    return rows.withColumn("date", F.to_date(local)).join(context, [key, "date"], "left")
