"""Registered queries: intraday features, experiment sets, sequences, information theory."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.expr import DAILY as AX
from barloom.operators import cleaning as C
from barloom.operators import infotheory as I
from barloom.operators import intraday as N
from barloom.operators import labels as L
from barloom.operators import sequences as Q
from barloom.plans.registry import query, rounded
from barloom.plans.sqltext import BARS, DAILY, INTRADAY, WIDE, clip0, full, lag, lead, r, rank_pct, w
from barloom.session import materialize
from barloom.sources.datasets import _bar_columns, daily_panel, intraday_bars, sector_map, table, wide_panel

KEY = ["ticker", "date"]
R1 = f"(ln(close) - {lag('ln(close)')})"
MOVES = f"""mv AS MATERIALIZED (SELECT *, {R1} AS r1, {clip0(f'(close - {lag("close")})')} AS g, {clip0(f'-(close - {lag("close")})')} AS l FROM {{src}})"""
RSI = f"100 - 100 / (1 + {full('avg', 'g', 14)} / ({full('avg', 'l', 14)} + 1e-9))"

# ---- wide one-target table ---------------------------------------------------

REGION_BARS = f"""daily AS MATERIALIZED (SELECT n_regionkey AS ticker, CAST(l_shipdate AS DATE) AS date, {BARS}
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


def region_panel(spark, sf_dir):
    """Daily bars per region: five tickers on a dense calendar."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ticker"))
    regions = s.join(sector_map(spark, sf_dir), "ticker").select("s_suppkey", F.col("sector").alias("ticker"))
    joined = lines.join(regions, lines.l_suppkey == regions.s_suppkey)
    return joined.groupBy("ticker", F.col("l_shipdate").cast("date").alias("date")).agg(*_bar_columns())


_U21 = {f"ret{k}": f"ln(close) - {lag('ln(close)', k)}" for k in (1, 5, 10, 20)}
_U21 |= {f"vol{k}": full("stddev_samp", "r1", k) for k in (10, 20)}
_U21 |= {f"mom{k}": f"close / {lag('close', k)} - 1" for k in (5, 20)} | {"rsi14": RSI}


@query(
    "u21_wide_target_table",
    f"WITH {REGION_BARS}, {MOVES.format(src='daily')}, f AS MATERIALIZED (SELECT ticker, date, "
    + ", ".join(f"{v} AS {k}" for k, v in _U21.items())
    + f", {lead('close')} > close AS up FROM mv), p AS (SELECT date, count(*) AS n, "
    + ", ".join(f'max(CASE WHEN ticker = {t} THEN {k} END) AS "{t}_{k}"' for t in range(5) for k in _U21)
    + ", coalesce(max(CASE WHEN ticker = 0 THEN CAST(up AS INTEGER) END), 0) AS y FROM f GROUP BY 1) SELECT date, "
    + ", ".join(f'round("{t}_{k}", 6) AS "{t}_{k}"' for t in range(5) for k in _U21)
    + ", y FROM p WHERE "
    + " AND ".join(f'"{t}_{k}" IS NOT NULL' for t in range(5) for k in _U21),
)
def u21(spark, sf_dir):
    out = N.wide_target_table(region_panel(spark, sf_dir), 0, range(5))
    return rounded(out, ["date", "y"])


_U22 = {f"ret{k}": f"ln(close) - {lag('ln(close)', k)}" for k in (1, 2, 3, 5, 10, 20)}
_U22 |= {f"vol{k}": full("stddev_samp", "r1", k) for k in (5, 10, 20, 60)}
_U22 |= {f"mom{k}": f"close / {lag('close', k)} - 1" for k in (5, 10, 20, 60)} | {"rsi14": RSI}
_U22 |= {f"dist52{e}": f"close / {full(m, 'close', 252)} - 1" for e, m in (("h", "max"), ("l", "min"))}


@query(
    "u22_direction_set",
    f"WITH {DAILY}, {MOVES.format(src='daily')}, f AS (SELECT ticker, date, count(*) OVER (PARTITION BY ticker) AS n, "
    + "(dense_rank() OVER (ORDER BY ticker) - 1)::DOUBLE AS ticker_id, "
    + ", ".join(f"{v} AS {k}" for k, v in _U22.items())
    + f", coalesce(CAST({lead('close')} > close AS INTEGER), 0) AS y FROM mv) SELECT ticker, date, ticker_id, y, "
    + ", ".join(r(k, k) for k in _U22)
    + " FROM f WHERE n >= 100 AND "
    + " AND ".join(f"{k} IS NOT NULL" for k in _U22),
)
def u22(spark, sf_dir):
    out = N.direction_set(daily_panel(spark, sf_dir))
    return rounded(out, [*KEY, "ticker_id", "y"], 6, list(_U22))


_U23 = {f"ret{k}": f"close / {lag('close', k)} - 1" for k in (1, 5, 10, 20)} | {
    "mom20": f"close / {lag('close', 20)} - 1",
    "vol20": full("stddev_samp", "s1", 20),
    "rsi14": RSI,
    "dist_hi": f"close / {full('max', 'close', 60)} - 1",
    "dist_lo": f"close / {full('min', 'close', 60)} - 1",
    "fwd": f"{lead('close')} / close - 1",
}
PROBE = (
    f"{MOVES.format(src='wide')}, mv2 AS MATERIALIZED (SELECT *, close / {lag('close')} - 1 AS s1 FROM mv), pb0 AS (SELECT ticker, date, count(*) OVER (PARTITION BY ticker) AS n, "
    + ", ".join(f"{v} AS {k}" for k, v in _U23.items())
    + " FROM mv2), pb AS MATERIALIZED (SELECT * FROM pb0 WHERE n >= 300 AND "
    + " AND ".join(f"{k} IS NOT NULL" for k in _U23)
    + ")"
)


@query("u23_probe_set", f"WITH {WIDE}, {PROBE} SELECT ticker, date, " + ", ".join(r(k, k) for k in _U23) + " FROM pb")
def u23(spark, sf_dir):
    return rounded(N.probe_set(wide_panel(spark, sf_dir)), KEY)


# ---- daily and bar sequence features ---------------------------------------------

_REL = (
    f"ln(1 + greatest(volume / (CASE WHEN count(volume) OVER {w(20)} >= 5 THEN median(volume) OVER {w(20)} END + 1e-9), 0))"
)
_DYN = f"""d1 AS MATERIALIZED (SELECT *, {R1} AS r1, {_REL} AS rel FROM daily),
 dy AS MATERIALIZED (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS pos, coalesce(r1, 0) AS r1, coalesce(abs(r1), 0) AS absr,
 {", ".join(f"coalesce({full('stddev_samp', 'r1', k)}, 0) AS rvol{k}" for k in (5, 10, 20, 60))},
 coalesce({full('stddev_samp', 'r1', 5)} / ({full('stddev_samp', 'r1', 20)} + 1e-9), 0) AS vol_ratio,
 coalesce(close / {lag('close', 10)} - 1, 0) AS mom10, coalesce(close / {lag('close', 20)} - 1, 0) AS mom20,
 coalesce(r1 - {lag('r1')}, 0) AS accel, coalesce(ln(volume + 1) - {lag('ln(volume + 1)')}, 0) AS dvol,
 coalesce(rel, 0) AS rel_vol, coalesce(sign(r1) * rel, 0) AS signed_vol FROM d1)"""


@query("u24_daily_dynamics", f"WITH {DAILY}, {_DYN} SELECT ticker, date, " + ", ".join(r(k, k) for k in N.DAILY_SEQUENCE) + " FROM dy")
def u24(spark, sf_dir):
    return rounded(N.daily_dynamics(daily_panel(spark, sf_dir)), KEY, 6, list(N.DAILY_SEQUENCE))


def _tw(n: int) -> str:
    return w(n, "ts")


_BARF = f"""{INTRADAY}, t0 AS MATERIALIZED (SELECT *, CAST(ts AS DATE) AS day, coalesce(ln(close) - {lag('ln(close)', 1, 'ts')}, 0.0) AS r1,
  row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) - 1 AS ip, count(*) OVER (PARTITION BY ticker) AS nb,
  coalesce(ln(1 + greatest(volume / (CASE WHEN count(volume) OVER {_tw(20)} >= 5 THEN median(volume) OVER {_tw(20)} END + 1e-9), 0)), 0) AS vrel FROM bars),
 ty AS (SELECT ticker, median(n) AS typical FROM (SELECT ticker, day, count(*) AS n FROM t0 GROUP BY 1, 2) GROUP BY 1),
 bf AS MATERIALIZED (SELECT t0.ticker, ts, day, r1, abs(r1) AS absr, """ + ", ".join(
    f"coalesce({full('stddev_samp', 'r1', k, None, 'ts').replace('PARTITION BY ticker', 'PARTITION BY t0.ticker')}, 0) AS rvol{k}" for k in (5, 15, 30)
) + f""", ln(greatest(high / low, 1 + 1e-9)) AS rng, vrel, sign(r1) * vrel AS signed_vol,
 coalesce({full('sum', 'r1', 5, None, 'ts').replace('PARTITION BY ticker', 'PARTITION BY t0.ticker')}, 0) AS mom5, coalesce(r1 - lag(r1) OVER (PARTITION BY t0.ticker ORDER BY ts), 0) AS accel,
 ip / typical AS tod, CASE WHEN ip = 0 THEN r1 ELSE 0.0 END AS gap FROM t0 JOIN ty ON t0.ticker = ty.ticker WHERE nb >= 400)"""


@query("u25_bar_features", f"WITH {_BARF} SELECT ticker, ts, " + ", ".join(r(k, k) for k in N.BAR_SEQUENCE) + " FROM bf")
def u25(spark, sf_dir):
    return rounded(N.bar_features(intraday_bars(spark, sf_dir)), ["ticker", "ts"], 6, list(N.BAR_SEQUENCE))


# Bars per user: sparse days, so the daily grid has holes.
_USER = """bars AS MATERIALIZED (SELECT CAST(user_id AS BIGINT) AS ticker, date_trunc('hour', ts) AS ts, sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100 AS close
 FROM events WHERE value > 0 GROUP BY 1, 2)"""
_RV = f"""{_USER}, b1 AS (SELECT *, ln(close) - {lag('ln(close)', 1, 'ts')} AS rr, count(*) OVER (PARTITION BY ticker) AS nb FROM bars),
 rv AS MATERIALIZED (SELECT ticker, CAST(ts AS DATE) AS date, stddev_samp(rr) AS iv FROM b1 WHERE nb >= 20 GROUP BY 1, 2)"""


def user_bars(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        table(spark, sf_dir, "events")
        .filter("value > 0")
        .groupBy(F.col("user_id").alias("ticker"), F.date_trunc("hour", F.col("ts")).alias("ts"))
        .agg((F.sum(cents) / F.count(F.lit(1)) / 100).alias("close"))
    )


@query("u26_realized_by_day", f"WITH {_RV} SELECT ticker, date, round(iv, 6) AS iv FROM rv")
def u26(spark, sf_dir):
    return rounded(N.realized_by_day(user_bars(spark, sf_dir), 20), KEY)


_EWT = """ w1 AS (SELECT g.ticker, g.date, a.iv, row_number() OVER (PARTITION BY g.ticker ORDER BY g.date) AS rn FROM gr g LEFT JOIN rv a USING (ticker, date)),
 w2 AS (SELECT *, lag(iv) OVER (PARTITION BY ticker ORDER BY date) AS past FROM w1),
 w3 AS (SELECT a.ticker, a.date, a.iv, sum(b.past * pow(2 / 3.0::DOUBLE, a.rn - b.rn)) / sum(CASE WHEN b.past IS NOT NULL THEN pow(2 / 3.0::DOUBLE, a.rn - b.rn) END) AS ew
  FROM w2 a JOIN w2 b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY 1, 2, 3)"""


@query(
    "u27_realized_context",
    f"""WITH {_RV}, gr AS (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM bars), (SELECT DISTINCT CAST(ts AS DATE) AS date FROM bars)), {_EWT},
 m AS (SELECT avg(iv) AS a, avg(ew) AS b FROM w3)
 SELECT ticker, date, round(coalesce(iv, a), 6) AS intraday_rv, round(coalesce(ew, b), 6) AS intraday_rv_ewma5, (iv IS NOT NULL)::DOUBLE AS intraday_avail FROM w3, m""",
)
def u27(spark, sf_dir):
    bars = user_bars(spark, sf_dir)
    days = bars.select("ticker", F.to_date("ts").alias("date"), F.lit(1).alias("one")).distinct()
    grid = C.on_calendar(days, "one").select(*KEY)
    return rounded(N.realized_context(grid, N.realized_by_day(bars, 20)), KEY)


# ---- sequences ------------------------------------------------------------------

SEQ = ("r1", "rvol5", "rel_vol")


def checks(seq: str, prefix: str) -> list:
    """Order-sensitive numbers of a sequence: length, first, last, weighted sum."""
    weighted = F.aggregate(
        F.transform(F.col(seq), lambda v, i: (i + 1) * (v[0] + 2 * v[1] + 3 * v[2])), F.lit(0.0), lambda a, x: a + x
    )
    return [
        F.size(seq).alias(f"{prefix}_steps"),
        F.round(F.element_at(seq, 1)[0], 6).alias(f"{prefix}_first"),
        F.round(F.element_at(seq, -1)[0], 6).alias(f"{prefix}_last"),
        F.round(weighted, 5).alias(f"{prefix}_sum"),
    ]


def sql_checks(lst: str, prefix: str) -> str:
    """The same for a SQL list of structs (a, b, c)."""
    return (
        f"CAST(len({lst}) AS INTEGER) AS {prefix}_steps, round({lst}[1].a, 6) AS {prefix}_first, round({lst}[len({lst})].a, 6) AS {prefix}_last,"
        f" round(list_sum(list_transform({lst}, lambda v, i: i * (v.a + 2 * v.b + 3 * v.c))), 5) AS {prefix}_sum"
    )


_STEP = "{'a': r1, 'b': rvol5, 'c': rel_vol}"


@query(
    "q01_lookback_sequences",
    f"""WITH {DAILY}, {_DYN}, s AS (SELECT ticker, date, list({_STEP}) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS seq FROM dy)
 SELECT ticker, date, {sql_checks('seq', 'seq')} FROM s WHERE len(seq) = 20""",
)
def q01(spark, sf_dir):
    df = N.daily_dynamics(daily_panel(spark, sf_dir)).select(*KEY, *SEQ)
    return Q.lookback_sequences(df, SEQ, 20).select(*KEY, *checks("seq", "seq"))


def _thin(w_: int, t: int) -> str:
    return f"list_transform(range({t}), lambda i: h[CAST(round_even(i * ((len(h) - 1) / {t - 1}.0::DOUBLE), 0) AS INTEGER) + 1])"


@query(
    "q02_sample_window",
    f"""WITH {DAILY}, {_DYN}, s AS (SELECT ticker, date, list({_STEP}) OVER {w(30)} AS h FROM dy),
 t AS (SELECT ticker, date, CASE WHEN len(h) <= 20 THEN list_concat(list_transform(range(20 - len(h)), lambda i: h[1]), h) ELSE {_thin(30, 20)} END AS seq FROM s)
 SELECT ticker, date, {sql_checks('seq', 'seq')} FROM t""",
)
def q02(spark, sf_dir):
    df = N.daily_dynamics(daily_panel(spark, sf_dir)).select(*KEY, *SEQ)
    return Q.sample_window(df, SEQ, 30, 20).select(*KEY, *checks("seq", "seq"))


@query(
    "q03_multiscale_sequences",
    f"""WITH {DAILY}, {_DYN}, s AS (SELECT ticker, date, pos, list({_STEP}) OVER {w(5)} AS s5, list({_STEP}) OVER {w(30)} AS s30, list({_STEP}) OVER {w(180)} AS s180 FROM dy),
 t AS (SELECT ticker, date, s5, {_thin(30, 20).replace('h[', 's30[').replace('len(h)', 'len(s30)')} AS t30, {_thin(180, 20).replace('h[', 's180[').replace('len(h)', 'len(s180)')} AS t180 FROM s WHERE pos > 180)
 SELECT ticker, date, {sql_checks('s5', 'w5')}, {sql_checks('t30', 'w30')}, {sql_checks('t180', 'w180')} FROM t""",
)
def q03(spark, sf_dir):
    df = N.daily_dynamics(daily_panel(spark, sf_dir)).select(*KEY, *SEQ)
    out = Q.multiscale_sequences(df, SEQ)
    return out.select(*KEY, *checks("seq5", "w5"), *checks("seq30", "w30"), *checks("seq180", "w180"))


@query(
    "q04_append_scalar",
    f"""WITH {DAILY}, {_DYN}, s AS (SELECT dy.ticker, dy.date, list({{'a': r1, 'b': rvol5}}) OVER (PARTITION BY dy.ticker ORDER BY dy.date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS seq, d.volume AS v
  FROM dy JOIN daily d USING (ticker, date))
 SELECT ticker, date, 3 AS width, round(list_sum(list_transform(seq, lambda x, i: i * (x.a + 2 * x.b + 3 * v / 1000))), 5) AS seq_sum FROM s WHERE len(seq) = 5""",
)
def q04(spark, sf_dir):
    df = N.daily_dynamics(daily_panel(spark, sf_dir)).withColumn("stack", F.col("volume") / 1000)
    df = Q.lookback_sequences(df, ["r1", "rvol5"], 5).select(*KEY, "seq", "stack")
    out = Q.append_scalar(df, ["seq"], "stack", F.col("date") < F.lit("1999-01-01").cast("date"))
    weighted = F.aggregate(
        F.transform("seq", lambda v, i: (i + 1) * (v[0] + 2 * v[1] + 3 * v[2])), F.lit(0.0), lambda a, x: a + x
    )
    return out.select(*KEY, F.size(F.col("seq")[0]).alias("width"), F.round(weighted, 5).alias("seq_sum"))


@query(
    "q05_day_context",
    f"""WITH {INTRADAY}, c AS (SELECT ticker, CAST(ts AS DATE) AS date, max(close) AS day_max, count(*) AS day_bars FROM bars GROUP BY 1, 2)
 SELECT b.ticker, ts, CAST(ts AS DATE) AS date, close / day_max AS rel, day_bars FROM bars b JOIN c ON b.ticker = c.ticker AND CAST(ts AS DATE) = c.date""",
)
def q05(spark, sf_dir):
    bars = intraday_bars(spark, sf_dir)
    ctx = bars.groupBy("ticker", F.to_date("ts").alias("date")).agg(
        F.max("close").alias("day_max"), F.count(F.lit(1)).alias("day_bars")
    )
    out = Q.day_context(bars, ctx)
    return out.select("ticker", "ts", "date", (F.col("close") / F.col("day_max")).alias("rel"), "day_bars")


# ---- information theory -----------------------------------------------------------

FEATS = [k for k in _U23 if k != "fwd"]
_YUP = "px AS MATERIALIZED (SELECT *, CAST(fwd > 0 AS INTEGER) AS up FROM pb)"


def _bin(c: str, b: int = 20) -> str:
    return f"CAST(coalesce(least(floor(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) * {b}), {b - 1}), 0) AS INTEGER)"


def _mi_sql(cols, y: str, src: str) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_bin(c)} AS bx, {_bin(y)} AS yb FROM {src}" for c in cols)
    return f"""mc AS (SELECT feature, bx, yb, count(*)::DOUBLE AS n FROM ({cells}) GROUP BY 1, 2, 3),
 hx AS (SELECT feature, -sum(p * log2(p)) AS h FROM (SELECT feature, sum(n) / sum(sum(n)) OVER (PARTITION BY feature) AS p FROM mc GROUP BY feature, bx) GROUP BY 1),
 hy AS (SELECT feature, -sum(p * log2(p)) AS h FROM (SELECT feature, sum(n) / sum(sum(n)) OVER (PARTITION BY feature) AS p FROM mc GROUP BY feature, yb) GROUP BY 1),
 hj AS (SELECT feature, -sum(p * log2(p)) AS h FROM (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p FROM mc) GROUP BY 1),
 mi AS MATERIALIZED (SELECT feature, greatest(hx.h + hy.h - hj.h, 0) AS mi FROM hx JOIN hy USING (feature) JOIN hj USING (feature))"""


def probe_frame(spark, sf_dir, columns=(*FEATS, "fwd", "up")):
    """The probe set with ``up``, of which ``columns`` are kept.

    Written once: fits and statistics read their rows many times, and the windows cost far more than a read.
    """
    df = N.probe_set(wide_panel(spark, sf_dir)).withColumn("up", (F.col("fwd") > 0).cast("int"))
    return materialize(df.select(*KEY, *columns), "probe")


@query(
    "i01_entropy",
    f"WITH {WIDE}, {PROBE}, {_YUP}, c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_bin(c)} AS b FROM px" for c in [*FEATS, "up"])
    + "), n AS (SELECT feature, b, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p FROM n) SELECT feature, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1",
)
def i01(spark, sf_dir):
    return rounded(I.entropy(probe_frame(spark, sf_dir), [*FEATS, "up"]), ["feature"])


@query("i02_mutual_information", f"WITH {WIDE}, {PROBE}, {_YUP}, {_mi_sql(FEATS, 'up', 'px')} SELECT feature, round(mi, 6) AS mi FROM mi")
def i02(spark, sf_dir):
    return rounded(I.mutual_information(probe_frame(spark, sf_dir), FEATS, "up"), ["feature"])


@query(
    "i03_top_by_information",
    f"WITH {WIDE}, {PROBE}, {_YUP}, {_mi_sql(FEATS, 'up', 'px')} SELECT feature, round(mi, 6) AS mi FROM mi ORDER BY mi.mi DESC, feature LIMIT 4",
)
def i03(spark, sf_dir):
    return rounded(I.top_by_information(probe_frame(spark, sf_dir), FEATS, "up", 4), ["feature"])


@query("i04_prune_correlated")
def i04(spark, sf_dir):
    """Features of the probe set left at 0.95 (mom20 repeats ret20)."""
    left = I.prune_correlated(probe_frame(spark, sf_dir, FEATS), FEATS)
    return spark.createDataFrame([(c,) for c in left], "feature string")


@query(
    "i06_context_selection",
    f"""WITH {WIDE}, {PROBE}, {_YUP}, {_mi_sql(FEATS, 'up', 'px')}, top AS (SELECT feature FROM mi ORDER BY mi.mi DESC, feature LIMIT 3),
 u AS ({" UNION ALL ".join(f"SELECT ticker, date, '{c}' AS feature, {c} AS v FROM (SELECT w.ticker, w.date, {c} FROM wide w LEFT JOIN px USING (ticker, date))" for c in FEATS)})
 SELECT feature, count(*) AS n, round(avg(coalesce(v, 0.5)), 6) AS mean FROM u SEMI JOIN top USING (feature) GROUP BY 1""",
)
def i06(spark, sf_dir):
    grid = wide_panel(spark, sf_dir).select(*KEY)
    df = C.align(grid, probe_frame(spark, sf_dir), KEY)
    out = I.context_selection(df, FEATS, "up", 3)
    chosen = [c for c in out.columns if c in FEATS]
    long = out.unpivot([], chosen, "feature", "v")
    return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(
    "i07_median_split_proxy",
    f"""WITH {WIDE}, {PROBE}, pz AS MATERIALIZED (SELECT *, CAST(fwd > (SELECT median(fwd) FROM pb) AS INTEGER) AS ys FROM pb), {_mi_sql(FEATS, 'ys', 'pz')}
 SELECT feature, round(mi, 6) AS mi FROM mi""",
)
def i07(spark, sf_dir):
    df = I.median_split(N.probe_set(wide_panel(spark, sf_dir)), "fwd", "ys")
    return rounded(I.mutual_information(df, FEATS, "ys"), ["feature"])


@query("i09_pca_scree")
def i09(spark, sf_dir):
    return I.pca_scree(probe_frame(spark, sf_dir, FEATS), FEATS)


@query(
    "i09_pca_two_columns",
    f"""WITH {WIDE}, {PROBE}, c AS (SELECT abs(corr(vol20, dist_hi)) AS rho FROM pb)
 SELECT 1 AS component, round((1 + rho) / 2, 6) AS explained, round((1 + rho) / 2, 6) AS cumulative FROM c
 UNION ALL SELECT 2, round((1 - rho) / 2, 6), 1.0::DOUBLE FROM c""",
)
def i09_two(spark, sf_dir):
    return rounded(I.pca_scree(probe_frame(spark, sf_dir, ["vol20", "dist_hi"]), ["vol20", "dist_hi"]), ["component"])


@query(
    "i10_class_balance",
    f"WITH {WIDE}, {PROBE}, {_YUP} SELECT up AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM px GROUP BY 1",
)
def i10(spark, sf_dir):
    return rounded(I.class_balance(probe_frame(spark, sf_dir), "up"), ["label", "n"])
