"""Extended indicators: oscillators, volume flow, trend, breakout, derivatives.

They share one axis, so a job that asks for all of them keeps one exchange.
Inputs are ``open high low close volume``.  Unlike the packaged set, exponential
means here have no warm-up: they start at the first non-null input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.ewm import Ewm, with_ewm
from barloom.functions.expr import DAILY, EPS, Axis, gain, loss, ratio
from barloom.operators.technicals import true_range


def _c(name: str = "close") -> Column:
    return F.col(name)


def typical() -> Column:
    return (_c("high") + _c("low") + _c()) / F.lit(3.0)


def cci(df: DataFrame, n: int = 20, ax: Axis = DAILY, out: str = "cci20") -> DataFrame:
    """Deviation of the typical price from its mean over the mean absolute deviation."""
    staged = df.withColumn("__tp", typical())
    staged = staged.withColumns(
        {"__sma": ax.full(F.avg, _c("__tp"), n), "__win": F.collect_list(_c("__tp")).over(ax.trailing(n))}
    )
    mad = F.expr(f"aggregate(__win, 0D, (acc, x) -> acc + abs(x - __sma)) / {n}")
    return staged.withColumn(out, (_c("__tp") - _c("__sma")) / (0.015 * mad + EPS)).drop("__tp", "__sma", "__win")


def williams_r(df: DataFrame, n: int = 14, ax: Axis = DAILY, out: str = "williams_r14") -> DataFrame:
    high = ax.full(F.max, _c("high"), n)
    low = ax.full(F.min, _c("low"), n)
    return df.withColumn(out, -100 * (high - _c()) / (high - low + EPS))


def chande_momentum(df: DataFrame, n: int = 14, ax: Axis = DAILY, out: str = "cmo14") -> DataFrame:
    delta = ax.diff(_c())
    staged = df.withColumns({"__gain": gain(delta), "__loss": loss(delta)})
    up = ax.full(F.sum, _c("__gain"), n)
    down = ax.full(F.sum, _c("__loss"), n)
    return staged.withColumn(out, 100.0 * (up - down) / (up + down + EPS)).drop("__gain", "__loss")


def awesome_oscillator(df: DataFrame, ax: Axis = DAILY, out: str = "awesome_osc") -> DataFrame:
    mid = (_c("high") + _c("low")) / F.lit(2.0)
    return df.withColumn(out, ax.full(F.avg, mid, 5) - ax.full(F.avg, mid, 34))


def trix(df: DataFrame, n: int = 15, ax: Axis = DAILY, out: str = "trix15") -> DataFrame:
    staged = df
    source = "close"
    for step in ("__e1", "__e2", "__e3"):
        staged = with_ewm(staged, ax, {step: Ewm.span(source, n)})
        source = step
    change = ratio(_c("__e3"), ax.lag(_c("__e3"))) - 1
    return staged.withColumn(out, change * 100).drop("__e1", "__e2", "__e3")


def on_balance_volume(df: DataFrame, ax: Axis = DAILY, out: str = "obv") -> DataFrame:
    signed = F.signum(F.coalesce(ax.diff(_c()), F.lit(0.0))) * _c("volume")
    return df.withColumn("__sv", signed).withColumn(out, F.sum("__sv").over(ax.running())).drop("__sv")


def chaikin_money_flow(df: DataFrame, n: int = 20, ax: Axis = DAILY, out: str = "cmf20") -> DataFrame:
    place = ((_c() - _c("low")) - (_c("high") - _c())) / (_c("high") - _c("low") + EPS)
    flow = ax.full(F.sum, place * _c("volume"), n)
    return df.withColumn(out, flow / (ax.full(F.sum, _c("volume"), n) + EPS))


def money_flow_index(df: DataFrame, n: int = 14, ax: Axis = DAILY, out: str = "mfi14") -> DataFrame:
    tp = typical()
    before = ax.lag(tp)
    raw = tp * _c("volume")
    staged = df.withColumns(
        {
            "__pos": F.when(tp > before, raw).otherwise(0.0),
            "__neg": F.when(tp < before, raw).otherwise(0.0),
        }
    )
    rs = ax.full(F.sum, _c("__pos"), n) / (ax.full(F.sum, _c("__neg"), n) + EPS)
    return staged.withColumn(out, 100.0 - 100.0 / (1.0 + rs)).drop("__pos", "__neg")


def klinger(df: DataFrame, short: int = 34, long: int = 55, ax: Axis = DAILY, out: str = "klinger") -> DataFrame:
    tp = typical()
    force = _c("volume") * F.when(tp > ax.lag(tp), 1.0).otherwise(-1.0)
    staged = with_ewm(
        df.withColumn("__sv", force), ax, {"__fast": Ewm.span("__sv", short), "__slow": Ewm.span("__sv", long)}
    )
    return staged.withColumn(out, _c("__fast") - _c("__slow")).drop("__sv", "__fast", "__slow")


def directional_movement(df: DataFrame, n: int = 14, ax: Axis = DAILY) -> DataFrame:
    """Adds adx14, plus_di14, minus_di14 and di_spread (names follow n)."""
    up = ax.diff(_c("high"))
    down = -ax.diff(_c("low"))
    staged = df.withColumns(
        {
            "__tr": true_range(ax),
            "__pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
            "__mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        }
    )
    smooth = {"__atr": "__tr", "__ps": "__pdm", "__ms": "__mdm"}
    staged = with_ewm(staged, ax, {k: Ewm.wilder(v, n) for k, v in smooth.items()})
    plus, minus = f"plus_di{n}", f"minus_di{n}"
    staged = staged.withColumns(
        {
            plus: 100.0 * _c("__ps") / (_c("__atr") + EPS),
            minus: 100.0 * _c("__ms") / (_c("__atr") + EPS),
        }
    ).withColumn("__dx", 100.0 * F.abs(_c(plus) - _c(minus)) / (_c(plus) + _c(minus) + EPS))
    staged = with_ewm(staged, ax, {f"adx{n}": Ewm.wilder("__dx", n)})
    return staged.withColumn("di_spread", _c(plus) - _c(minus)).drop(
        "__tr", "__pdm", "__mdm", "__atr", "__ps", "__ms", "__dx"
    )


def ichimoku_distance(df: DataFrame, ax: Axis = DAILY, out: str = "ichimoku_dist") -> DataFrame:
    def middle(n: int) -> Column:
        return (ax.full(F.max, _c("high"), n) + ax.full(F.min, _c("low"), n)) / F.lit(2.0)

    staged = df.withColumns({"__a": (middle(9) + middle(26)) / F.lit(2.0), "__b": middle(52)})
    cloud = (ax.lag(_c("__a"), 26) + ax.lag(_c("__b"), 26)) / F.lit(2.0)
    return staged.withColumn(out, (_c() - cloud) / (_c() + EPS)).drop("__a", "__b")


def rolling_vwap(df: DataFrame, n: int = 20, ax: Axis = DAILY) -> DataFrame:
    """Adds vwap{n} and vwap_dev, the close's relative distance to it."""
    value = ax.full(F.sum, typical() * _c("volume"), n) / (ax.full(F.sum, _c("volume"), n) + EPS)
    staged = df.withColumn(f"vwap{n}", value)
    return staged.withColumn("vwap_dev", (_c() - _c(f"vwap{n}")) / (_c() + EPS))


def donchian_breakout(df: DataFrame, n: int = 20, ax: Axis = DAILY, out: str = "don_breakout20") -> DataFrame:
    """Against the previous row's bands: the upper from highs, the lower from closes."""
    staged = df.withColumns({"__hi": ax.full(F.max, _c("high"), n), "__lo": ax.full(F.min, _c(), n)})
    staged = staged.withColumns({"__hi": ax.lag(_c("__hi")), "__lo": ax.lag(_c("__lo"))})
    signal = F.when(_c() < _c("__lo"), -1.0).when(_c() > _c("__hi"), 1.0).otherwise(0.0)
    return staged.withColumn(out, signal).drop("__hi", "__lo")


def squeeze_release(df: DataFrame, n: int = 20, ax: Axis = DAILY, out: str = "bb_squeeze_rel") -> DataFrame:
    bands = ratio(4.0 * ax.full(F.stddev_samp, _c(), n), _c())
    channel = ratio(4.0 * ax.full(F.avg, _c("high") - _c("low"), n), _c())
    staged = df.withColumn("__tight", F.coalesce(bands < channel, F.lit(False)))
    released = F.coalesce(ax.lag(_c("__tight")), F.lit(False)) & ~_c("__tight")
    return staged.withColumn(out, released.cast("double")).drop("__tight")


def rsi_change(df: DataFrame, n: int = 14, step: int = 3, ax: Axis = DAILY) -> DataFrame:
    """Adds rsi{n}_w (exponential, epsilon form) and rsi_roc{step}."""
    delta = ax.diff(_c())
    staged = df.withColumns({"__gain": gain(delta), "__loss": loss(delta)})
    staged = with_ewm(staged, ax, {"__up": Ewm.wilder("__gain", n), "__down": Ewm.wilder("__loss", n)})
    name = f"rsi{n}_w"
    staged = staged.withColumn(name, 100.0 - 100.0 / (1.0 + _c("__up") / (_c("__down") + EPS)))
    return staged.withColumn(f"rsi_roc{step}", ax.diff(_c(name), step)).drop("__gain", "__loss", "__up", "__down")


def macd_change(
    df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, step: int = 3, ax: Axis = DAILY
) -> DataFrame:
    """Adds macd_hist_nw (no warm-up) and macd_hist_roc{step}."""
    staged = with_ewm(df, ax, {"__fast": Ewm.span("close", fast), "__slow": Ewm.span("close", slow)})
    staged = staged.withColumn("__line", _c("__fast") - _c("__slow"))
    staged = with_ewm(staged, ax, {"__signal": Ewm.span("__line", signal)})
    staged = staged.withColumn("macd_hist_nw", _c("__line") - _c("__signal"))
    return staged.withColumn(f"macd_hist_roc{step}", ax.diff(_c("macd_hist_nw"), step)).drop(
        "__fast", "__slow", "__line", "__signal"
    )


def derivatives(df: DataFrame, ax: Axis = DAILY) -> DataFrame:
    """Adds vol_roc5 and price_accel."""
    v = _c("volume")
    staged = df.withColumns({"vol_roc5": ratio(v, ax.lag(v, 5)) - 1, "__pc": ratio(_c(), ax.lag(_c())) - 1})
    return staged.withColumn("price_accel", ax.diff(_c("__pc"))).drop("__pc")


# The names the full set adds, in output order.
EXTENDED = (
    "cci20",
    "williams_r14",
    "cmo14",
    "awesome_osc",
    "trix15",
    "obv",
    "cmf20",
    "mfi14",
    "klinger",
    "adx14",
    "di_spread",
    "ichimoku_dist",
    "vwap_dev",
    "don_breakout20",
    "bb_squeeze_rel",
    "rsi_roc3",
    "macd_hist_roc3",
    "vol_roc5",
    "price_accel",
)


def extended_features(df: DataFrame, ax: Axis = DAILY) -> DataFrame:
    """All extended indicators on one axis."""
    out = df
    for step in (
        cci,
        williams_r,
        chande_momentum,
        awesome_oscillator,
        trix,
        on_balance_volume,
        chaikin_money_flow,
        money_flow_index,
        klinger,
        directional_movement,
        ichimoku_distance,
        rolling_vwap,
        donchian_breakout,
        squeeze_release,
        rsi_change,
        macd_change,
        derivatives,
    ):
        out = step(out, ax=ax)
    return out.select(*df.columns, *EXTENDED)
