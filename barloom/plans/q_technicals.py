"""Registered queries: per-ticker indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.ewm import Ewm, with_ewm
from barloom.functions.expr import DAILY as AX
from barloom.operators import extended as X
from barloom.operators import technicals as T
from barloom.plans.registry import query, rounded
from barloom.plans.sqltext import (
    DAILY,
    MARKET,
    OVER,
    clip0,
    ewm,
    full,
    lag,
    lead,
    r,
    rank_pct,
    w,
    warm,
)
from barloom.sources.datasets import daily_panel, market_frame
from barloom.operators.ranking import with_ranks

KEY = ["ticker", "date"]


def _simple(name, fn, cols: dict[str, str], digits: int | dict[str, int] = 6, ctes: str = "", source: str = "daily"):
    """Register an indicator whose check is one SELECT over the daily panel."""
    d = lambda c: digits if isinstance(digits, int) else digits.get(c, 6)
    body = ", ".join(r(sql, c, d(c)) for c, sql in cols.items())
    head = "WITH RECURSIVE " if "UNION ALL" in ctes else "WITH "
    text = f"{head}{DAILY}{',' + ctes if ctes else ''} SELECT ticker, date, {body} FROM {source}"

    @query(name, text)
    def run(spark, sf_dir):
        return rounded(fn(daily_panel(spark, sf_dir)), KEY, digits, list(cols))


R1 = f"(ln(close) - {lag('ln(close)')})"
BASE = f""" base AS MATERIALIZED (SELECT *, {R1} AS r1, close - {lag('close')} AS dc,
 {lag('close')} AS pc, (high + low + close) / 3.0::DOUBLE AS tp FROM daily)"""
MOVES = f"""{BASE}, moves AS MATERIALIZED (SELECT *, {clip0('dc')} AS g, {clip0('-dc')} AS l,
 greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM base)"""

_simple(
    "t01_log_return",
    lambda d: T.log_returns(d, (1, 5, 20)),
    {f"log_return_{k}": f"ln(close) - {lag('ln(close)', k)}" for k in (1, 5, 20)},
)

_EMA = (9, 21, 50, 200)
_simple(
    "t02_ema",
    lambda d: T.ema(d, _EMA),
    {f"ema_{p}": warm(f"e{p}", p, "close") for p in _EMA}
    | {f"close_over_ema_{p}": f"close / {warm(f'e{p}', p, 'close')} - 1" for p in _EMA},
    {f"ema_{p}": 4 for p in _EMA},
    ewm("sm", "daily", {f"e{p}": ("close", 2.0 / (p + 1)) for p in _EMA}),
    "sm",
)

_GAPS = f"""WITH RECURSIVE {DAILY}, g AS MATERIALIZED (SELECT ticker, date, n, CASE WHEN n % 9 <> 0 THEN close END AS c
  FROM (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM daily)),
 y(ticker, n, v, gap) AS (SELECT ticker, n, c, 1 FROM g WHERE n = 1 UNION ALL
  SELECT g.ticker, g.n, CASE WHEN g.c IS NULL THEN y.v ELSE (pow(0.8::DOUBLE, y.gap) * y.v + 0.2::DOUBLE * g.c) / (pow(0.8::DOUBLE, y.gap) + 0.2::DOUBLE) END,
   CASE WHEN g.c IS NULL THEN y.gap + 1 ELSE 1 END FROM y JOIN g ON g.ticker = y.ticker AND g.n = y.n + 1)
 SELECT ticker, date, round(v, 4) AS ema_9 FROM y JOIN g USING (ticker, n)"""


@query("t02_ema_gaps", _GAPS)
def t02_gaps(spark, sf_dir):
    """Every ninth close is missing: the mean keeps its value there and its weight decays."""
    n = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    df = daily_panel(spark, sf_dir).withColumn("__n", n).withColumn("close", F.when(F.col("__n") % 9 != 0, F.col("close")))
    return with_ewm(df, AX, {"ema_9": Ewm.span("close", 9)}).select("ticker", "date", F.round("ema_9", 4).alias("ema_9"))


_MACD = ewm("a", "daily", {"f": ("close", 2 / 13), "s": ("close", 2 / 27)}) + (
    f", m AS MATERIALIZED (SELECT *, {warm('f', 12, 'close')} - {warm('s', 26, 'close')} AS line FROM a),"
    + ewm("b", "m", {"sg": ("line", 0.2)})
)
_simple(
    "t03_macd",
    T.macd,
    {
        "macd": "line",
        "macd_signal": warm("sg", 9, "line"),
        "macd_hist": f"line - {warm('sg', 9, 'line')}",
    },
    4,
    _MACD,
    "b",
)

_simple(
    "t04_rsi",
    T.rsi,
    {"rsi_14": f"100 - 100 / (1 + {warm('eg', 14, 'g')} / nullif({warm('el', 14, 'l')}, 0))"},
    6,
    MOVES + "," + ewm("sm", "moves", {"eg": ("g", 1 / 14), "el": ("l", 1 / 14)}),
    "sm",
)

_simple(
    "t05_realized_vol",
    T.realized_volatility,
    {"realized_vol_20": f"{full('stddev_pop', 'r1', 20)} * sqrt(252.0::DOUBLE)"},
    6,
    BASE,
    "base",
)

_simple(
    "t06_atr",
    T.atr,
    {"atr_14": warm("etr", 14, "tr"), "atr_14_pct": f"{warm('etr', 14, 'tr')} / close"},
    {"atr_14": 4},
    MOVES + "," + ewm("sm", "moves", {"etr": ("tr", 1 / 14)}),
    "sm",
)

_simple(
    "t07_bollinger",
    T.bollinger,
    {
        "bb_width_20": f"4 * {full('stddev_pop', 'close', 20)} / {full('avg', 'close', 20)}",
        "bb_z_20": f"(close - {full('avg', 'close', 20)}) / nullif({full('stddev_pop', 'close', 20)}, 0)",
    },
)

_simple(
    "t08_rate_of_change",
    lambda d: T.rate_of_change(d, (5, 10, 20)),
    {f"roc_{k}": f"close / {lag('close', k)} - 1" for k in (5, 10, 20)},
)

_simple(
    "t09_rolling_high_low",
    lambda d: T.rolling_high_low(d, (20, 60, 252)),
    {f"dist_to_high_{k}": f"close / {full('max', 'close', k)} - 1" for k in (20, 60, 252)}
    | {f"dist_to_low_{k}": f"close / {full('min', 'close', k)} - 1" for k in (20, 60, 252)},
)

_simple(
    "t10_close_in_range",
    T.close_in_range,
    {
        "close_in_range_20": f"(close - {full('min', 'low', 20)})"
        f" / nullif({full('max', 'high', 20)} - {full('min', 'low', 20)}, 0)"
    },
)

# ---- pyramid --------------------------------------------------------------

PYRAMID_SQL = (
    {f"ret{k}": f"ln(close) - {lag('ln(close)', k)}" for k in T.RETURN_LAGS}
    | {f"vol{k}": full("stddev_samp", "r1", k) for k in T.VOL_WINDOWS}
    | {f"mom{k}": f"close / {lag('close', k)} - 1" for k in T.MOMENTUM_LAGS}
    | {
        "vol_ratio": f"{full('stddev_samp', 'r1', 5)} / nullif({full('stddev_samp', 'r1', 20)}, 0)",
        "ma50_ratio": f"close / {full('avg', 'close', 50)} - 1",
        "ma200_ratio": f"close / {full('avg', 'close', 200)} - 1",
        "ma50_200_cross": f"{full('avg', 'close', 50)} / {full('avg', 'close', 200)} - 1",
        "ret_accel": f"{lag('ln(close)', 20)} - {lag('ln(close)', 5)}",
        "rsi14": f"100 - 100 / (1 + {warm('eg', 14, 'g')} / nullif({warm('el', 14, 'l')}, 0))",
        "dist52h": f"close / {full('max', 'close', 252)} - 1",
        "dist52l": f"close / {full('min', 'close', 252)} - 1",
        "dist3yh": f"close / {full('max', 'close', 756)} - 1",
        "dist3yl": f"close / {full('min', 'close', 756)} - 1",
    }
)
_PYR = (
    MOVES
    + ","
    + ewm("sm", "moves", {"eg": ("g", 1 / 14), "el": ("l", 1 / 14)})
    + ", py AS MATERIALIZED (SELECT ticker, date, count(*) OVER (PARTITION BY ticker) AS n_rows, "
    + ", ".join(f"{v} AS {k}" for k, v in PYRAMID_SQL.items())
    + f", {lead('ln(close)')} - ln(close) AS fwd FROM sm)"
)
_PYR_KEEP = "n_rows >= 756 AND " + " AND ".join(f"{c} IS NOT NULL" for c in T.PYRAMID)


@query(
    "t11_return_pyramid",
    f"WITH RECURSIVE {DAILY}, {_PYR} SELECT ticker, date, "
    + ", ".join(r(c, c) for c in (*T.PYRAMID, "fwd"))
    + f" FROM py WHERE {_PYR_KEEP}",
)
def t11(spark, sf_dir):
    return rounded(T.return_pyramid(daily_panel(spark, sf_dir)), KEY)


@query(
    "t12_regime",
    f"""WITH {DAILY}, {MARKET},
 m1 AS (SELECT date, close, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS r FROM market),
 m2 AS (SELECT date,
  CASE WHEN count(r) OVER z = 20 THEN stddev_pop(r) OVER z * sqrt(252.0::DOUBLE) END AS v,
  CASE WHEN count(close) OVER z200 = 200 THEN avg(close) OVER z50 / avg(close) OVER z200 - 1 END AS t
  FROM m1 WINDOW z AS (ORDER BY date ROWS 19 PRECEDING), z50 AS (ORDER BY date ROWS 49 PRECEDING),
   z200 AS (ORDER BY date ROWS 199 PRECEDING)),
 m3 AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN v <= 0.1 THEN 0.0 WHEN v <= 0.2 THEN 1.0
   WHEN v <= 0.4 THEN 2.0 ELSE 3.0 END::DOUBLE AS b FROM m2)
 SELECT ticker, d.date, {r('v', 'market_realized_vol')}, {r('t', 'market_trend_50_200')}, b AS market_vol_bucket
 FROM daily d LEFT JOIN m3 USING (date)""",
)
def t12(spark, sf_dir):
    out = T.regime(daily_panel(spark, sf_dir), market_frame(spark, sf_dir))
    return rounded(out, KEY, 6, ["market_realized_vol", "market_trend_50_200", "market_vol_bucket"])


_T13_LIST = [
    "log_return_1", "log_return_5", "ema_50", "close_over_ema_9", "macd_hist", "rsi_14", "roc_10",
    "realized_vol_20", "atr_14_pct", "bb_width_20", "bb_z_20", "dist_to_high_60", "dist_to_low_252",
    "close_in_range_20", "market_realized_vol", "market_trend_50_200", "market_vol_bucket",
]
_T13_SQL = {
    "log_return_1": "r1",
    "log_return_5": f"ln(close) - {lag('ln(close)', 5)}",
    "ema_50": warm("e50", 50, "close"),
    "close_over_ema_9": f"close / {warm('e9', 9, 'close')} - 1",
    "macd_hist": f"line - {warm('sg', 9, 'line')}",
    "rsi_14": f"100 - 100 / (1 + {warm('eg', 14, 'g')} / nullif({warm('el', 14, 'l')}, 0))",
    "roc_10": f"close / {lag('close', 10)} - 1",
    "realized_vol_20": f"{full('stddev_pop', 'r1', 20)} * sqrt(252.0::DOUBLE)",
    "atr_14_pct": f"{warm('etr', 14, 'tr')} / close",
    "bb_width_20": f"4 * {full('stddev_pop', 'close', 20)} / {full('avg', 'close', 20)}",
    "bb_z_20": f"(close - {full('avg', 'close', 20)}) / nullif({full('stddev_pop', 'close', 20)}, 0)",
    "dist_to_high_60": f"close / {full('max', 'close', 60)} - 1",
    "dist_to_low_252": f"close / {full('min', 'close', 252)} - 1",
    "close_in_range_20": f"(close - {full('min', 'low', 20)})"
    f" / nullif({full('max', 'high', 20)} - {full('min', 'low', 20)}, 0)",
}
_T13_DIGITS = {"ema_50": 4, "macd_hist": 4}


@query(
    "t13_feature_set",
    f"""WITH RECURSIVE {DAILY}, {MARKET}, {MOVES},
 {ewm("a", "moves", {"f": ("close", 2 / 13), "s": ("close", 2 / 27), "e9": ("close", 0.2), "e50": ("close", 2 / 51),
                     "eg": ("g", 1 / 14), "el": ("l", 1 / 14), "etr": ("tr", 1 / 14)})},
 m AS MATERIALIZED (SELECT *, {warm('f', 12, 'close')} - {warm('s', 26, 'close')} AS line FROM a),
 {ewm("b", "m", {"sg": ("line", 0.2)})},
 m1 AS (SELECT date, close, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS r FROM market),
 m2 AS (SELECT date,
  CASE WHEN count(r) OVER z = 20 THEN stddev_pop(r) OVER z * sqrt(252.0::DOUBLE) END AS v,
  CASE WHEN count(close) OVER z200 = 200 THEN avg(close) OVER z50 / avg(close) OVER z200 - 1 END AS t
  FROM m1 WINDOW z AS (ORDER BY date ROWS 19 PRECEDING), z50 AS (ORDER BY date ROWS 49 PRECEDING),
   z200 AS (ORDER BY date ROWS 199 PRECEDING)),
 m3 AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN v <= 0.1 THEN 0.0 WHEN v <= 0.2 THEN 1.0
   WHEN v <= 0.4 THEN 2.0 ELSE 3.0 END::DOUBLE AS bk FROM m2)
 SELECT ticker, b.date, {", ".join(r(v, k, _T13_DIGITS.get(k, 6)) for k, v in _T13_SQL.items())},
 {r('v', 'market_realized_vol')}, {r('t', 'market_trend_50_200')}, bk AS market_vol_bucket
 FROM b LEFT JOIN m3 USING (date)""",
)
def t13(spark, sf_dir):
    out = T.build_features(daily_panel(spark, sf_dir), T.STANDARD_CONFIG, market_frame(spark, sf_dir))
    return rounded(out, KEY, _T13_DIGITS, _T13_LIST)


_T14 = ["ret1", "ret20", "vol20", "mom60", "rsi14", "ma50_ratio", "dist52h", "dist3yl"]


@query(
    "t14_ranked_pyramid",
    f"WITH RECURSIVE {DAILY}, {_PYR}, kept AS MATERIALIZED (SELECT * FROM py WHERE {_PYR_KEEP}) SELECT ticker, date, "
    + ", ".join(r(rank_pct(c, "date"), f"{c}_rank") for c in T.PYRAMID)
    + " FROM kept",
)
def t14(spark, sf_dir):
    out = T.return_pyramid(daily_panel(spark, sf_dir))
    ranked = with_ranks(out, ["date"], {f"{c}_rank": c for c in T.PYRAMID})
    return rounded(ranked, KEY, 6, [f"{c}_rank" for c in T.PYRAMID])


# ---- modular set ------------------------------------------------------------

MODULAR_SQL = PYRAMID_SQL | {
    "vol_ratio": f"{full('stddev_samp', 'r1', 5)} / ({full('stddev_samp', 'r1', 20)} + 1e-9)",
    "ma50_200_cross": f"{full('avg', 'close', 50)} / ({full('avg', 'close', 200)} + 1e-9) - 1",
    "ret_accel": f"ln(close) - {lag('ln(close)', 5)} - ({lag('ln(close)', 5)} - {lag('ln(close)', 20)})",
    "rsi14": f"100 - 100 / (1 + {full('avg', 'g', 14)} / ({full('avg', 'l', 14)} + 1e-9))",
} | {
    f"sharpe{k}": f"(ln(close) - {lag('ln(close)', k)}) / ({full('stddev_samp', 'r1', k)} + 1e-9)"
    for k in (5, 20, 60, 252)
} | {
    "rel_vol5": f"volume / ({full('avg', 'volume', 20)} + 1e-9)",
    "rel_vol20": f"volume / ({full('avg', 'volume', 60)} + 1e-9)",
    "vol_accel": f"(volume / ({full('avg', 'volume', 5)} + 1e-9))"
    f" / (({full('avg', 'volume', 5)} + 1e-9) / ({full('avg', 'volume', 20)} + 1e-9) + 1e-9)",
}
MODULAR_CTE = (
    MOVES
    + ", md AS MATERIALIZED (SELECT ticker, date, close, high, low, volume, r1, count(*) OVER (PARTITION BY ticker) AS n_rows, "
    + ", ".join(f"{MODULAR_SQL[c]} AS {c}" for c in T.MODULAR)
    + f", {lead('ln(close)')} - ln(close) AS fwd FROM moves)"
)


@query(
    "u01_modular_features",
    f"WITH {DAILY}, {MODULAR_CTE} SELECT ticker, date, "
    + ", ".join(r(c, c) for c in T.MODULAR if not c.startswith(("sharpe", "rel_", "vol_accel")))
    + " FROM md WHERE n_rows >= 300",
)
def u01(spark, sf_dir):
    out = T.modular_features(daily_panel(spark, sf_dir))
    return rounded(out, KEY, 6, [c for c in T.MODULAR if not c.startswith(("sharpe", "rel_", "vol_accel"))])


@query(
    "u02_sharpe",
    f"WITH {DAILY}, {MODULAR_CTE} SELECT ticker, date, "
    + ", ".join(r(f"sharpe{k}", f"sharpe{k}") for k in (5, 20, 60, 252))
    + " FROM md WHERE n_rows >= 300",
)
def u02(spark, sf_dir):
    out = T.modular_features(daily_panel(spark, sf_dir))
    return rounded(out, KEY, 6, [f"sharpe{k}" for k in (5, 20, 60, 252)])


@query(
    "u03_relative_volume",
    f"WITH {DAILY}, {MODULAR_CTE} SELECT ticker, date, "
    + ", ".join(r(c, c) for c in ("rel_vol5", "rel_vol20", "vol_accel"))
    + " FROM md WHERE n_rows >= 300",
)
def u03(spark, sf_dir):
    out = T.modular_features(daily_panel(spark, sf_dir))
    return rounded(out, KEY, 6, ["rel_vol5", "rel_vol20", "vol_accel"])


# ---- extended set -----------------------------------------------------------

_CCI = f"""{BASE}, c1 AS MATERIALIZED (SELECT *, row_number() OVER {OVER} AS rn FROM base),
 c2 AS (SELECT a.ticker, a.date, a.tp, avg(b.tp) AS sma, count(*) AS n, list(b.tp) AS xs
  FROM c1 a JOIN c1 b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 19 AND a.rn GROUP BY a.ticker, a.date, a.tp),
 c3 AS (SELECT ticker, date, tp, sma, n, list_avg(list_transform(xs, lambda x: abs(x - sma))) AS mad FROM c2)"""
_simple(
    "u04_cci",
    X.cci,
    {"cci20": "CASE WHEN n = 20 THEN (tp - sma) / (0.015::DOUBLE * mad + 1e-9) END"},
    5,
    _CCI,
    "c3",
)
_simple(
    "u05_williams_r",
    X.williams_r,
    {
        "williams_r14": f"-100 * ({full('max', 'high', 14)} - close)"
        f" / ({full('max', 'high', 14)} - {full('min', 'low', 14)} + 1e-9)"
    },
)
_simple(
    "u06_chande_momentum",
    X.chande_momentum,
    {
        "cmo14": f"100 * ({full('sum', 'g', 14)} - {full('sum', 'l', 14)})"
        f" / ({full('sum', 'g', 14)} + {full('sum', 'l', 14)} + 1e-9)"
    },
    6,
    MOVES,
    "moves",
)
_simple(
    "u07_awesome_oscillator",
    X.awesome_oscillator,
    {"awesome_osc": f"{full('avg', '(high + low) / 2', 5)} - {full('avg', '(high + low) / 2', 34)}"},
    6,
)
_simple(
    "u08_trix",
    X.trix,
    {"trix15": f"({'e3'} / {lag('e3')} - 1) * 100"},
    6,
    ewm("s1", "daily", {"e1": ("close", 0.125)})
    + ","
    + ewm("s2", "s1", {"e2": ("e1", 0.125)})
    + ","
    + ewm("s3", "s2", {"e3": ("e2", 0.125)}),
    "s3",
)
_simple(
    "u09_obv",
    X.on_balance_volume,
    {"obv": f"sum(sign(coalesce(dc, 0)) * volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"},
    2,
    BASE,
    "base",
)
_FLOW = BASE + ", fl AS (SELECT *, ((close - low) - (high - close)) / (high - low + 1e-9) * volume AS mf FROM base)"
_simple(
    "u10_chaikin_money_flow",
    X.chaikin_money_flow,
    {"cmf20": f"{full('sum', 'mf', 20)} / ({full('sum', 'volume', 20)} + 1e-9)"},
    6,
    _FLOW,
    "fl",
)
_MFI = (
    BASE
    + f", f0 AS (SELECT *, {lag('tp')} AS ptp FROM base), fl AS (SELECT *, CASE WHEN tp > ptp THEN tp * volume ELSE 0.0 END AS pf,"
    " CASE WHEN tp < ptp THEN tp * volume ELSE 0.0 END AS nf FROM f0)"
)
_simple(
    "u11_money_flow_index",
    X.money_flow_index,
    {"mfi14": f"100 - 100 / (1 + {full('sum', 'pf', 14)} / ({full('sum', 'nf', 14)} + 1e-9))"},
    6,
    _MFI,
    "fl",
)
_KLI = BASE + f", kv AS (SELECT *, CASE WHEN tp > {lag('tp')} THEN volume ELSE -volume END AS sv FROM base),"
_simple(
    "u12_klinger",
    X.klinger,
    {"klinger": "kf - ks"},
    5,
    _KLI + ewm("sm", "kv", {"kf": ("sv", 2 / 35), "ks": ("sv", 2 / 56)}),
    "sm",
)
_ADX = (
    MOVES
    + f""", d0 AS (SELECT *, high - {lag('high')} AS up, -(low - {lag('low')}) AS dn FROM moves),
 d1 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm,
  CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm FROM d0),"""
    + ewm("s1", "d1", {"ea": ("tr", 1 / 14), "ep": ("pdm", 1 / 14), "em": ("mdm", 1 / 14)})
    + """, d2 AS (SELECT *, 100 * ep / (ea + 1e-9) AS pdi, 100 * em / (ea + 1e-9) AS mdi FROM s1),
 d3 AS (SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-9) AS dx FROM d2),"""
    + ewm("s2", "d3", {"ax": ("dx", 1 / 14)})
)
_simple(
    "u13_adx",
    X.directional_movement,
    {"adx14": "ax", "plus_di14": "pdi", "minus_di14": "mdi", "di_spread": "pdi - mdi"},
    6,
    _ADX,
    "s2",
)


def _mid(n: int) -> str:
    return f"({full('max', 'high', n)} + {full('min', 'low', n)}) / 2"


_simple(
    "u14_ichimoku",
    X.ichimoku_distance,
    {"ichimoku_dist": f"(close - ({lag('sa', 26)} + {lag('sb', 26)}) / 2) / (close + 1e-9)"},
    6,
    f" ic AS (SELECT *, ({_mid(9)} + {_mid(26)}) / 2 AS sa, {_mid(52)} AS sb FROM daily)",
    "ic",
)
_VW = f"({full('sum', 'tp * volume', 20)} / ({full('sum', 'volume', 20)} + 1e-9))"
_simple(
    "u15_vwap",
    X.rolling_vwap,
    {"vwap20": _VW, "vwap_dev": f"(close - {_VW}) / (close + 1e-9)"},
    {"vwap20": 4},
    BASE,
    "base",
)
_DON = f" b0 AS (SELECT *, {full('max', 'high', 20)} AS bh, {full('min', 'close', 20)} AS bl FROM daily), b1 AS (SELECT *, {lag('bh')} AS ph, {lag('bl')} AS pl FROM b0)"
_simple(
    "u16_donchian",
    X.donchian_breakout,
    {"don_breakout20": "CASE WHEN close < pl THEN -1.0 WHEN close > ph THEN 1.0 ELSE 0.0 END::DOUBLE"},
    6,
    _DON,
    "b1",
)
_SQZ = (
    f" q0 AS (SELECT *, coalesce(4 * {full('stddev_samp', 'close', 20)} / close < 4 * {full('avg', 'high - low', 20)} / close, false) AS sq FROM daily),"
    f" q1 AS (SELECT *, coalesce({lag('sq')}, false) AS psq FROM q0)"
)
_simple(
    "u17_squeeze_release",
    X.squeeze_release,
    {"bb_squeeze_rel": "CASE WHEN psq AND NOT sq THEN 1.0 ELSE 0.0 END::DOUBLE"},
    6,
    _SQZ,
    "q1",
)
_RSIW = (
    MOVES
    + ","
    + ewm("sm", "moves", {"eg": ("g", 1 / 14), "el": ("l", 1 / 14)})
    + ", rw AS (SELECT *, 100 - 100 / (1 + eg / (el + 1e-9)) AS rsiw FROM sm)"
)
_simple("u18_rsi_change", X.rsi_change, {"rsi14_w": "rsiw", "rsi_roc3": f"rsiw - {lag('rsiw', 3)}"}, 6, _RSIW, "rw")
_MACDN = (
    ewm("a", "daily", {"f": ("close", 2 / 13), "s": ("close", 2 / 27)})
    + ", m AS (SELECT *, f - s AS line FROM a),"
    + ewm("b", "m", {"sg": ("line", 0.2)})
    + ", h AS (SELECT *, line - sg AS hist FROM b)"
)
_simple(
    "u19_macd_change",
    X.macd_change,
    {"macd_hist_nw": "hist", "macd_hist_roc3": f"hist - {lag('hist', 3)}"},
    4,
    _MACDN,
    "h",
)
_simple(
    "u20_derivatives",
    X.derivatives,
    {"vol_roc5": f"volume / {lag('volume', 5)} - 1", "price_accel": f"pch - {lag('pch')}"},
    6,
    f" pc AS (SELECT *, close / {lag('close')} - 1 AS pch FROM daily)",
    "pc",
)
