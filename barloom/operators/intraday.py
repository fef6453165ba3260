"""Bar-level features, realised volatility per day, and experiment feature sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ewm import Ewm, with_ewm
from barloom.functions.expr import DAILY, EPS, Axis, clip, gain, loss, ratio
from barloom.functions.rolling import Roll, with_rolling
from barloom.operators.blocks import blocked, owned

BARS = Axis(("ticker",), "ts")


def _c(name: str = "close") -> Column:
    return F.col(name)


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def rolling_median(x: Column, n: int, least: int, ax: Axis) -> Column:
    w = ax.trailing(n)
    return F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(0.5)).over(w))


def relative_volume(v: Column, ax: Axis) -> Column:
    """log1p of volume over its trailing 20-row median (5 rows at least)."""
    return F.log1p(clip(v / (rolling_median(v, 20, 5, ax) + EPS), lo=0.0))


DAILY_SEQUENCE = (
    "r1", "absr", "rvol5", "rvol10", "rvol20", "rvol60", "vol_ratio",
    "mom10", "mom20", "accel", "dvol", "rel_vol", "signed_vol",
)


def daily_dynamics(df: DataFrame, ax: Axis = DAILY) -> DataFrame:
    """The 13 daily sequence features; missing values are 0."""
    c, v = _c(), _c("volume")
    staged = df.withColumns({"r1": ax.log_return(c), "__rel": relative_volume(v, ax)})
    r1 = _c("r1")
    staged = staged.withColumns(
        {f"rvol{k}": ax.full(F.stddev_samp, r1, k) for k in (5, 10, 20, 60)}
        | {
            "absr": F.abs(r1),
            "mom10": ratio(c, ax.lag(c, 10)) - 1,
            "mom20": ratio(c, ax.lag(c, 20)) - 1,
            "accel": ax.diff(r1),
            "dvol": ax.diff(F.log(v + 1.0)),
            "rel_vol": _c("__rel"),
            "signed_vol": F.signum(r1) * _c("__rel"),
        }
    ).withColumn("vol_ratio", _c("rvol5") / (_c("rvol20") + EPS))
    return staged.withColumns({f: _zero(_c(f)) for f in DAILY_SEQUENCE}).drop("__rel")


BAR_SEQUENCE = (
    "r1", "absr", "rvol5", "rvol15", "rvol30", "rng", "vrel", "signed_vol", "mom5", "accel", "tod", "gap",
)


def bar_features(df: DataFrame, min_bars: int = 400, ax: Axis = BARS) -> DataFrame:
    """The 12 bar features.  Series are cut into blocks, so no task holds one ticker.

    ``tod`` is the bar's place in its day over the ticker's median bars per day;
    ``gap`` is the return over the night, on the first bar of a day.
    """
    key, day = list(ax.keys), "day"
    dated = df.withColumn(day, F.to_date(ax.time))
    per_day = dated.groupBy(*key, day).agg(F.count(F.lit(1)).alias("__bars"))
    per_key = per_day.groupBy(*key).agg(
        F.median("__bars").cast("double").alias("__typical"), F.sum("__bars").alias("__total")
    )
    within = Window.partitionBy(*key, day).orderBy(ax.time)
    dated = dated.withColumn("__in_day", (F.row_number().over(within) - 1).cast("double"))
    dated = dated.join(per_key.filter(F.col("__total") >= min_bars), key)
    cut, bx = blocked(dated, ax, back=33)
    v = _c("volume")
    staged = cut.withColumns({"r1": _zero(bx.log_return(_c())), "vrel": _zero(relative_volume(v, bx))})
    r1 = _c("r1")
    high_low = F.log(clip(ratio(_c("high"), _c("low")), lo=1.0 + EPS))
    staged = staged.withColumns(
        {f"rvol{k}": _zero(bx.full(F.stddev_samp, r1, k)) for k in (5, 15, 30)}
        | {
            "absr": F.abs(r1),
            "rng": _zero(high_low),
            "signed_vol": F.signum(r1) * _c("vrel"),
            "mom5": _zero(bx.full(F.sum, r1, 5)),
            "accel": _zero(bx.diff(r1)),
            "tod": _c("__in_day") / _c("__typical"),
            "gap": F.when(_c("__in_day") == 0, r1).otherwise(0.0),
        }
    )
    return owned(staged).drop("__in_day", "__typical", "__total", "pos")


def realized_by_day(df: DataFrame, min_bars: int = 50, ax: Axis = BARS) -> DataFrame:
    """(ticker, date, iv): deviation of bar log returns per day, the night included."""
    key = list(ax.keys)
    long_enough = df.groupBy(*key).agg(F.count("close").alias("__n")).filter(F.col("__n") >= min_bars)
    kept = df.join(long_enough, key, "left_semi")
    cut, bx = blocked(kept, ax, back=1)
    rows = owned(cut.withColumn("__r", bx.log_return(_c())))
    return rows.groupBy(*key, F.to_date(ax.time).alias("date")).agg(F.stddev_samp("__r").alias("iv"))


def realized_context(grid: DataFrame, realized: DataFrame, span: float = 5.0, ax: Axis = DAILY) -> DataFrame:
    """intraday_rv, its past-only exponential forecast and an availability flag on the grid.

    Missing values take the mean of the rows that have one.
    """
    joined = grid.join(realized, [*ax.keys, ax.time], "left")
    joined = joined.withColumn("__past", ax.lag(_c("iv")))
    joined = with_ewm(joined, ax, {"__ew": Ewm.span("__past", span, 1, adjust=True)})
    means = joined.agg(F.struct(F.avg("iv").alias("a"), F.avg("__ew").alias("b"))).scalar()
    out = joined.withColumn("__m", means)
    return out.withColumns(
        {
            "intraday_rv": F.coalesce(_c("iv"), _c("__m.a"), F.lit(0.0)),
            "intraday_rv_ewma5": F.coalesce(_c("__ew"), _c("__m.b"), F.lit(0.0)),
            "intraday_avail": _c("iv").isNotNull().cast("double"),
        }
    ).drop("iv", "__past", "__ew", "__m")


def coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(_c(column).isNotNull().cast("double")).alias("coverage"))


# ---- experiment feature sets -----------------------------------------------------


def simple_rsi(df: DataFrame, n: int, ax: Axis, out: str) -> DataFrame:
    """RSI with plain means."""
    delta = ax.diff(_c())
    staged = df.withColumns({"__gain": gain(delta), "__loss": loss(delta)})
    up = ax.full(F.avg, _c("__gain"), n)
    down = ax.full(F.avg, _c("__loss"), n)
    return staged.withColumn(out, 100 - 100 / (1 + up / (down + EPS))).drop("__gain", "__loss")


def wide_target_table(df: DataFrame, target, tickers: Sequence, ax: Axis = DAILY) -> DataFrame:
    """One row per date: nine features per ticker as columns, and the target's next move.

    The tickers become columns, so their list is given.  Incomplete dates are dropped.
    """
    c = _c()
    staged = simple_rsi(df.withColumn("__r", ax.log_return(c)), 14, ax, "rsi14")
    cols = {f"ret{k}": ax.log_return(c, k) for k in (1, 5, 10, 20)}
    cols |= {f"vol{k}": ax.full(F.stddev_samp, _c("__r"), k) for k in (10, 20)}
    cols |= {f"mom{k}": ratio(c, ax.lag(c, k)) - 1 for k in (5, 20)}
    cols["__next"] = F.log(ax.lead(c)) - F.log(c)
    staged = staged.withColumns(cols)
    names = ["ret1", "ret5", "ret10", "ret20", "vol10", "vol20", "mom5", "mom20", "rsi14"]
    whole = F.lit(True)
    for n in names:
        whole = whole & _c(n).isNotNull()
    staged = staged.withColumn("__whole", whole).filter(_c("ticker").isin(list(tickers)))
    cells = [F.max(F.when(_c("ticker") == t, _c(n))).alias(f"{t}_{n}") for t in tickers for n in names]
    # A date is complete when every ticker is: one number instead of a test per column.
    wide = staged.groupBy(ax.time).agg(F.count_if("__whole").alias("__n"), *cells)
    wide = wide.filter(_c("__n") == len(tickers)).drop("__n")
    label = staged.filter(_c("ticker") == target).select(ax.time, (_c("__next") > 0).cast("int").alias("y"))
    return wide.join(label.withColumn("y", F.coalesce("y", F.lit(0))), ax.time)


def key_positions(df: DataFrame, key: str, out: str) -> DataFrame:
    """0-based place of every distinct key in key order, from counts per key prefix."""
    keys = df.select(key).distinct()
    text = dict(df.dtypes)[key] == "string"
    chunk = F.substring(_c(key), 1, 3) if text else F.floor(_c(key) / 4096)
    staged = keys.withColumn("__chunk", chunk)
    along = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = staged.groupBy("__chunk").agg(F.count(F.lit(1)).alias("__n"))
    base = base.select("__chunk", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("__chunk").orderBy(key)
    return staged.join(base, "__chunk").select(key, (_c("__b") + F.row_number().over(inside) - 1).alias(out))


DIRECTION_SET = (
    *(f"ret{k}" for k in (1, 2, 3, 5, 10, 20)),
    *(f"vol{k}" for k in (5, 10, 20, 60)),
    *(f"mom{k}" for k in (5, 10, 20, 60)),
    "rsi14",
    "dist52h",
    "dist52l",
    "ticker_id",
)


def direction_set(df: DataFrame, min_len: int = 100, ax: Axis = DAILY) -> DataFrame:
    """18 direction features with the ticker's number, and y: whether the next return is positive."""
    c = _c()
    ids = key_positions(df, "ticker", "__id")
    staged = df.withColumn("__len", F.count(c).over(ax.whole())).filter(_c("__len") >= min_len)
    staged = simple_rsi(staged.withColumn("__r", ax.log_return(c)), 14, ax, "rsi14")
    cols = {f"ret{k}": ax.log_return(c, k) for k in (1, 2, 3, 5, 10, 20)}
    cols |= {f"vol{k}": ax.full(F.stddev_samp, _c("__r"), k) for k in (5, 10, 20, 60)}
    cols |= {f"mom{k}": ratio(c, ax.lag(c, k)) - 1 for k in (5, 10, 20, 60)}
    staged = with_rolling(staged, ax, {"__hi": Roll("max", "close", 252), "__lo": Roll("min", "close", 252)})
    cols["dist52h"] = ratio(c, _c("__hi")) - 1
    cols["dist52l"] = ratio(c, _c("__lo")) - 1
    # The last row has no next return and counts as "not up".
    cols["y"] = F.coalesce((ax.lead(c) > c).cast("int"), F.lit(0))
    staged = staged.withColumns(cols).join(ids, "ticker").withColumn("ticker_id", _c("__id").cast("double"))
    return staged.select(*ax.keys, ax.time, *DIRECTION_SET, "y").dropna("any", subset=list(DIRECTION_SET))


PROBE_SET = ("ret1", "ret5", "ret10", "ret20", "mom20", "vol20", "rsi14", "dist_hi", "dist_lo")


def probe_set(df: DataFrame, min_len: int = 300, ax: Axis = DAILY) -> DataFrame:
    """Nine simple-return features and ``fwd``, the next simple return."""
    c = _c()
    change = lambda k: ratio(c, ax.lag(c, k)) - 1
    staged = df.withColumn("__len", F.count(c).over(ax.whole())).filter(_c("__len") >= min_len)
    staged = simple_rsi(staged.withColumn("ret1", change(1)), 14, ax, "rsi14")
    out = staged.withColumns(
        {f"ret{k}": change(k) for k in (5, 10, 20)}
        | {
            "mom20": change(20),
            "vol20": ax.full(F.stddev_samp, _c("ret1"), 20),
            "dist_hi": ratio(c, ax.full(F.max, c, 60)) - 1,
            "dist_lo": ratio(c, ax.full(F.min, c, 60)) - 1,
            "fwd": ratio(ax.lead(c), c) - 1,
        }
    )
    return out.select(*ax.keys, ax.time, *PROBE_SET, "fwd").dropna("any")
