"""Registered queries: labels, and the flagship summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import Axis
from barloom.operators import cleaning as C
from barloom.operators import labels as L
from barloom.operators import technicals as T
from barloom.operators.blocks import blocked, owned
from barloom.plans.registry import query, rounded
from barloom.plans.sqltext import DAILY, INTRADAY, WIDE, ahead, lag, lead, r, rank_avg, rank_pct
from barloom.sources.datasets import daily_panel, intraday_bars, table, wide_panel

KEY = ["ticker", "date"]
R1 = f"(ln(close) - {lag('ln(close)')})"
FWD = f"f AS MATERIALIZED (SELECT ticker, date, {lead('ln(close)')} - ln(close) AS fwd FROM wide)"


@query(
    "flagship_label_summary",
    f"""WITH {DAILY}, b AS (SELECT ticker, date, {R1} AS log_return_1, {lead('ln(close)')} - ln(close) AS fwd FROM daily WHERE volume > 0),
 k AS (SELECT *, {rank_pct('fwd', 'date')} AS p FROM b)
 SELECT date, count(*) AS n, count(CASE WHEN p >= 0.8::DOUBLE AND NOT p <= 0.2::DOUBLE THEN 1 END) AS n_top,
  count(CASE WHEN p <= 0.2::DOUBLE THEN 1 END) AS n_bottom, round(avg(log_return_1), 6) AS mean_return,
  round(avg(CASE WHEN p >= 0.8::DOUBLE AND NOT p <= 0.2::DOUBLE THEN fwd END), 6) AS top_fwd,
  round(avg(CASE WHEN p <= 0.2::DOUBLE THEN fwd END), 6) AS bottom_fwd FROM k GROUP BY 1""",
)
def flagship(spark, sf_dir):
    bars = C.drop_zero_volume(daily_panel(spark, sf_dir))
    df = L.forward_returns(T.log_returns(bars, (1,)), (1,), "fwd")
    df = L.top_bottom_by_rank(df, "fwd1")
    return df.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("n_top"),
        F.count_if(F.col("label") == 0).alias("n_bottom"),
        F.round(F.avg("log_return_1"), 6).alias("mean_return"),
        F.round(F.avg(F.when(F.col("label") == 1, F.col("fwd1"))), 6).alias("top_fwd"),
        F.round(F.avg(F.when(F.col("label") == 0, F.col("fwd1"))), 6).alias("bottom_fwd"),
    )


@query(
    "l01_direction",
    f"WITH {DAILY} SELECT ticker, date, CAST({lead('close', 5)} > close AS INTEGER) AS y_binary_h5 FROM daily",
)
def l01(spark, sf_dir):
    return L.direction(daily_panel(spark, sf_dir), 5).select(*KEY, "y_binary_h5")


@query(
    "l02_forward_returns",
    f"WITH {DAILY} SELECT ticker, date, "
    + ", ".join(r(f"{lead('ln(close)', h)} - ln(close)", f"y_logret_h{h}") for h in (1, 5, 20))
    + " FROM daily",
)
def l02(spark, sf_dir):
    return rounded(L.forward_returns(daily_panel(spark, sf_dir), (1, 5, 20)), KEY, 6, [f"y_logret_h{h}" for h in (1, 5, 20)])


@query(
    "l03_quantile_sequence_targets",
    f"WITH {DAILY} SELECT ticker, date, "
    + ", ".join(r(f"{lead('ln(close)', h)} - ln(close)", f"{p}{h}") for h in (1, 5) for p in ("y_quantile_h", "y_seq_h"))
    + " FROM daily",
)
def l03(spark, sf_dir):
    df = L.sequence_targets(L.quantile_targets(daily_panel(spark, sf_dir), (1, 5)), (1, 5))
    return rounded(df, KEY, 6, ["y_quantile_h1", "y_quantile_h5", "y_seq_h1", "y_seq_h5"])


@query(
    "l04_regime_class",
    f"""WITH {DAILY}, b AS (SELECT *, close / {lag('close')} - 1 AS pc, {lead('ln(close)', 5)} - ln(close) AS fwd FROM daily),
 v AS (SELECT *, CASE WHEN count(pc) OVER {ahead(5)} = 5 THEN stddev_samp(pc) OVER {ahead(5)} * sqrt(252.0::DOUBLE) END AS vol FROM b)
 SELECT ticker, date, CAST(CASE WHEN fwd > 0.005::DOUBLE THEN 2 WHEN fwd < -0.005::DOUBLE THEN 0 ELSE 1 END * 2
  + CASE WHEN vol IS NULL THEN NULL WHEN vol <= 0.15::DOUBLE THEN 0 WHEN vol <= 0.30::DOUBLE THEN 1 ELSE 2 END AS DOUBLE) AS y_regime_h5 FROM v""",
)
def l04(spark, sf_dir):
    return L.regime_class(daily_panel(spark, sf_dir)).select(*KEY, "y_regime_h5")


@query(
    "l05_top_bottom_by_count",
    f"""WITH {WIDE}, {FWD}, k AS (SELECT *, {rank_avg('fwd', 'date')} AS rk, count(*) OVER (PARTITION BY date) AS n FROM f)
 SELECT ticker, date, CASE WHEN rk > n - greatest(1.0, round_even(n * 0.3::DOUBLE, 0)) THEN 1.0
  WHEN rk <= greatest(1.0, round_even(n * 0.3::DOUBLE, 0)) THEN 0.0 END::DOUBLE AS y_cs_quantile FROM k""",
)
def l05(spark, sf_dir):
    df = L.forward_returns(wide_panel(spark, sf_dir), (1,), "fwd")
    return L.top_bottom_by_count(df, "fwd1").select(*KEY, "y_cs_quantile")


@query(
    "l06_top_bottom_by_rank",
    f"""WITH {WIDE}, {FWD}, k AS (SELECT *, {rank_pct('fwd', 'date')} AS p FROM f)
 SELECT ticker, date, round(fwd, 6) AS fwd1, CASE WHEN p <= 0.2::DOUBLE THEN 0 ELSE 1 END AS label FROM k WHERE p <= 0.2::DOUBLE OR p >= 0.8::DOUBLE""",
)
def l06(spark, sf_dir):
    df = L.forward_returns(wide_panel(spark, sf_dir), (1,), "fwd")
    out = L.top_bottom_by_rank(df, "fwd1").filter("label is not null")
    return out.select(*KEY, F.round("fwd1", 6).alias("fwd1"), "label")


VOL = lambda h: (
    f"abs({lead('r1')})"
    if h == 1
    else f"(CASE WHEN count(r1) OVER {ahead(h)} = {h} THEN stddev_samp(r1) OVER {ahead(h)} END)"
)
HS = (1, 5, 10, 30, 90, 180)
VOLS = (
    f"b AS MATERIALIZED (SELECT ticker, date, close, {R1} AS r1 FROM daily), v AS MATERIALIZED (SELECT ticker, date, "
    + ", ".join(f"{VOL(h)} AS h{h}" for h in HS)
    + ", "
    + ", ".join(f"{lead('ln(close)', h)} - ln(close) AS r{h}" for h in HS)
    + " FROM b)"
)


@query(
    "l07_forward_volatility",
    f"WITH {DAILY}, {VOLS} SELECT ticker, date, round(h5, 6) AS fwd5, round(h30, 6) AS fwd30, NULL::DOUBLE AS fwd1 FROM v",
)
def l07(spark, sf_dir):
    ax = L.DAILY
    df = daily_panel(spark, sf_dir).withColumn("r1", ax.log_return(F.col("close")))
    df = df.withColumns({f"fwd{h}": L.forward_volatility(F.col("r1"), h) for h in (1, 5, 30)})
    return rounded(df, KEY, 6, ["fwd1", "fwd5", "fwd30"])


@query(
    "l08_volatility_median_split",
    f"WITH {DAILY}, {VOLS} SELECT ticker, date, "
    + ", ".join(f"CASE WHEN h{h} IS NOT NULL THEN CAST({rank_pct(f'h{h}', 'date')} >= 0.5 AS DOUBLE) END AS y{h}" for h in HS)
    + " FROM v",
)
def l08(spark, sf_dir):
    df = L.volatility_targets(daily_panel(spark, sf_dir), HS)
    return L.volatility_labels(df, HS).select(*KEY, *[f"y{h}" for h in HS])


@query(
    "l09_volatility_extreme_split",
    f"WITH {DAILY}, {VOLS}, k AS (SELECT ticker, date, "
    + ", ".join(f"{rank_pct(f'h{h}', 'date')} AS p{h}, r{h}" for h in HS)
    + " FROM v), "
    + "u AS ("
    + " UNION ALL ".join(f"SELECT ticker, date, {h} AS horizon, p{h} AS p, r{h} AS r FROM k" for h in HS)
    + """) SELECT ticker, date, horizon, CASE WHEN p <= 0.3::DOUBLE THEN 0.0 WHEN p >= 0.7::DOUBLE THEN 1.0 END::DOUBLE AS y,
 round(r, 6) AS r FROM u WHERE p <= 0.3::DOUBLE OR p >= 0.7::DOUBLE""",
)
def l09(spark, sf_dir):
    df = L.volatility_targets(daily_panel(spark, sf_dir), HS, returns=True)
    wide = L.volatility_labels(df, HS, 0.3)
    parts = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y{h}").alias("y"), F.col(f"r{h}").alias("r")) for h in HS])
    long = wide.select(*KEY, F.explode(parts).alias("p")).select(*KEY, "p.*").filter("y is not null")
    return long.withColumn("r", F.round("r", 6))


BARS = ("ticker", "ts")
IHS = (1, 3, 6)
_DAYED = f"""{INTRADAY}, d AS MATERIALIZED (SELECT *, CAST(ts AS DATE) AS day,
 coalesce(ln(close) - {lag('ln(close)', 1, 'ts')}, 0.0) AS r1 FROM bars)"""
_WDV = lambda h: (
    f"CASE WHEN {lead('day', h, 'ts')} = day THEN "
    + (
        f"abs({lead('r1', 1, 'ts')})"
        if h == 1
        else f"CASE WHEN count(r1) OVER {ahead(h, 'ts')} = {h} THEN stddev_samp(r1) OVER {ahead(h, 'ts')} END"
    )
    + " END"
)
_WDR = lambda h: f"CASE WHEN {lead('day', h, 'ts')} = day THEN {lead('ln(close)', h, 'ts')} - ln(close) END"
_WD = f"{_DAYED}, t AS MATERIALIZED (SELECT ticker, ts, " + ", ".join(
    f"{_WDV(h)} AS h{h}, {_WDR(h)} AS r{h}" for h in IHS
) + " FROM d)"


def within_day(spark, sf_dir):
    """Bars are cut into blocks, so a busy ticker is spread over tasks."""
    bars = intraday_bars(spark, sf_dir).withColumn("day", F.to_date("ts"))
    cut, ax = blocked(bars, Axis(("ticker",), "ts"), back=1, ahead=max(IHS))
    return owned(L.within_day_targets(cut, IHS, ax))


@query(
    "l10_within_day_targets",
    f"WITH {_WD} SELECT ticker, ts, " + ", ".join(f"{r(f'h{h}', f'h{h}')}, {r(f'r{h}', f'r{h}')}" for h in IHS) + " FROM t",
)
def l10(spark, sf_dir):
    return rounded(within_day(spark, sf_dir), list(BARS), 6, [f"{c}{h}" for h in IHS for c in "hr"])


@query(
    "l11_intraday_rank_split",
    f"WITH {_WD} SELECT ticker, ts, "
    + ", ".join(f"CASE WHEN h{h} IS NOT NULL THEN CAST({rank_pct(f'h{h}', 'ts')} >= 0.5 AS DOUBLE) END AS y{h}" for h in IHS)
    + " FROM t",
)
def l11(spark, sf_dir):
    return L.volatility_labels(within_day(spark, sf_dir), IHS, time="ts").select("ticker", "ts", *[f"y{h}" for h in IHS])


@query(
    "l12_above_median",
    f"""WITH {WIDE}, f AS (SELECT ticker, date, {lead('close')} / close - 1 AS fwd FROM wide),
 m AS (SELECT date, median(fwd) AS med FROM f GROUP BY 1)
 SELECT ticker, date, CAST(fwd > med AS INTEGER) AS y_cs FROM f JOIN m USING (date)""",
)
def l12(spark, sf_dir):
    df = wide_panel(spark, sf_dir)
    df = df.withColumn("fwd", L.DAILY.lead(F.col("close")) / F.col("close") - 1)
    return L.above_median(df, "fwd").select(*KEY, "y_cs")


@query(
    "l13_mean_volatility_by_horizon",
    f"WITH {DAILY}, {VOLS} "
    + " UNION ALL ".join(f"SELECT {h} AS horizon, round(avg(h{h}), 6) AS mean_vol FROM v" for h in HS),
)
def l13(spark, sf_dir):
    out = L.mean_by_horizon(L.volatility_targets(daily_panel(spark, sf_dir), HS), HS)
    return out.withColumn("mean_vol", F.round("mean_vol", 6))
