"""Registered queries: cleaning, filters, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cleaning as C
from barloom.operators import labels as L
from barloom.operators import technicals as T
from barloom.plans.registry import query, rounded
from barloom.plans.sqltext import DAILY, MARKET, OVER, WIDE, full, lag, lead, r
from barloom.sources.datasets import daily_panel, market_frame, table, wide_panel

KEY = ["ticker", "date"]
R1 = f"(ln(close) - {lag('ln(close)')})"
GAPPY = """gappy AS MATERIALIZED (SELECT t.ticker, c.date, d.close FROM (SELECT DISTINCT ticker FROM daily) t
 CROSS JOIN (SELECT DISTINCT date FROM daily) c LEFT JOIN daily d ON d.ticker = t.ticker AND d.date = c.date)"""
DATES = """dates AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n
 FROM (SELECT DISTINCT date FROM daily))"""


@query(
    "c01_drop_zero_volume",
    f"""WITH {DAILY}, v AS (SELECT ticker, date, close, CASE WHEN volume < 20 THEN 0 ELSE volume END AS volume FROM daily)
 SELECT ticker, date, close, volume FROM v WHERE volume > 0""",
)
def c01(spark, sf_dir):
    thin = daily_panel(spark, sf_dir).withColumn("volume", F.when(F.col("volume") < 20, 0.0).otherwise(F.col("volume")))
    return C.drop_zero_volume(thin).select(*KEY, "close", "volume")


@query(
    "c02_forward_fill",
    f"""WITH {DAILY}, {GAPPY} SELECT ticker, date, last_value(close IGNORE NULLS) OVER
 (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS close FROM gappy""",
)
def c02(spark, sf_dir):
    gappy = C.on_calendar(daily_panel(spark, sf_dir), "close")
    return C.forward_fill(gappy, ["close"], 2).select(*KEY, "close")


@query(
    "c03_winsorize",
    f"""WITH {DAILY}, b AS (SELECT ticker, date, {R1} AS x FROM daily),
 q AS (SELECT ticker, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM b GROUP BY 1)
 SELECT b.ticker, date, round(CASE WHEN x IS NULL THEN NULL ELSE least(greatest(x, lo), hi) END, 6) AS log_return_1
 FROM b JOIN q ON b.ticker = q.ticker""",
)
def c03(spark, sf_dir):
    df = T.log_returns(daily_panel(spark, sf_dir), (1,))
    return rounded(C.winsorize(df, "log_return_1", 0.005, 0.995), KEY, 6, ["log_return_1"])


@query(
    "c04_missing_report",
    f"""WITH {DAILY}, f AS (SELECT {R1} AS log_return_1, ln(close) - {lag('ln(close)', 20)} AS log_return_20,
  {full('avg', 'close', 200)} AS ma200, close FROM daily),
 n AS (SELECT count(*) AS n, count(*) - count(log_return_1) AS a, count(*) - count(log_return_20) AS b,
  count(*) - count(ma200) AS c, count(*) - count(close) AS d FROM f)
 SELECT 'log_return_1' AS column_name, a AS missing, round(a / n, 6) AS pct FROM n UNION ALL
 SELECT 'log_return_20', b, round(b / n, 6) FROM n UNION ALL SELECT 'ma200', c, round(c / n, 6) FROM n UNION ALL
 SELECT 'close', d, round(d / n, 6) FROM n""",
)
def c04(spark, sf_dir):
    df = T.log_returns(daily_panel(spark, sf_dir), (1, 20))
    df = df.withColumn("ma200", T.DAILY.full(F.avg, F.col("close"), 200))
    out = C.missing_report(df, ["log_return_1", "log_return_20", "ma200", "close"])
    return out.withColumn("pct", F.round("pct", 6))


@query(
    "c05_median_impute",
    f"""WITH {DAILY}, b AS (SELECT ticker, date, {R1} AS x, {full('avg', 'close', 600)} AS y FROM daily)
 SELECT ticker, date, round(coalesce(x, median(x) OVER (PARTITION BY ticker), 0), 6) AS log_return_1,
  round(coalesce(y, median(y) OVER (PARTITION BY ticker), 0), 4) AS ma600 FROM b""",
)
def c05(spark, sf_dir):
    df = T.log_returns(daily_panel(spark, sf_dir), (1,))
    df = df.withColumn("ma600", T.DAILY.full(F.avg, F.col("close"), 600))
    return rounded(C.median_impute(df, ["log_return_1", "ma600"]), KEY, {"ma600": 4}, ["log_return_1", "ma600"])


@query(
    "c06_drop_stale",
    f"""WITH {DAILY}, m AS (SELECT max(date) AS top FROM daily),
 flat AS (SELECT ticker, date, CASE WHEN ticker % 3 = 0 AND date >= top - INTERVAL 2 YEAR THEN 100.0::DOUBLE ELSE close END AS close FROM daily, m),
 b AS (SELECT ticker, {R1} AS x, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS age FROM flat)
 SELECT ticker, count(*) AS n FROM flat SEMI JOIN (SELECT ticker FROM b WHERE age <= 60 GROUP BY 1 HAVING stddev_samp(x) > 1e-8) k USING (ticker) GROUP BY 1""",
)
def c06(spark, sf_dir):
    daily = daily_panel(spark, sf_dir)
    top = F.add_months(daily.agg(F.max("date")).scalar(), -24)
    flat = daily.withColumn(
        "close", F.when((F.col("ticker") % 3 == 0) & (F.col("date") >= top), 100.0).otherwise(F.col("close"))
    )
    return C.drop_stale(flat).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c07_liquid",
    f"""WITH {DAILY}, k AS (SELECT ticker FROM daily GROUP BY 1 HAVING median(close * volume) >= 60000)
 SELECT ticker, count(*) AS n, round(median(close * volume), 2) AS median_value FROM daily SEMI JOIN k USING (ticker) GROUP BY 1""",
)
def c07(spark, sf_dir):
    kept = C.liquid(daily_panel(spark, sf_dir), 60000.0)
    return kept.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.median(F.col("close") * F.col("volume")), 2).alias("median_value")
    )


@query(
    "c08_min_history",
    f"""WITH {DAILY} SELECT ticker, count(*) AS n FROM daily GROUP BY 1 HAVING count(*) >= 756""",
)
def c08(spark, sf_dir):
    return C.min_history(daily_panel(spark, sf_dir), 756).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c09_date_stride",
    f"WITH {DAILY}, {DATES} SELECT ticker, date, close FROM daily JOIN dates USING (date) WHERE p % 9 = 0",
)
def c09(spark, sf_dir):
    return C.date_stride(daily_panel(spark, sf_dir), 9).select(*KEY, "close")


@query(
    "c10_row_stride",
    f"""WITH {DAILY} SELECT ticker, date, close FROM daily
 QUALIFY (row_number() OVER {OVER} - 1) % 5 = 0""",
)
def c10(spark, sf_dir):
    return C.row_stride(daily_panel(spark, sf_dir), 5).select(*KEY, "close")


@query(
    "c11_calendar_align",
    f"""WITH {DAILY}, {MARKET} SELECT ticker, date, d.close, e.n AS n_events
 FROM daily d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1) e USING (date)""",
)
def c11(spark, sf_dir):
    per_day = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    return C.align(daily_panel(spark, sf_dir), per_day, ["date"]).select(*KEY, "close", "n_events")


@query(
    "c12_describe",
    f"""WITH {DAILY}, b AS (SELECT {R1} AS log_return_1, close, volume FROM daily),
 l AS (SELECT 'log_return_1' AS column_name, log_return_1 AS v FROM b UNION ALL SELECT 'close', close FROM b
  UNION ALL SELECT 'volume', volume FROM b)
 SELECT column_name, count(v) AS count, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(min(v), 5) AS min,
  round(max(v), 5) AS max, round(quantile_cont(v, 0.01), 5) AS p1, round(quantile_cont(v, 0.5), 5) AS p50,
  round(quantile_cont(v, 0.99), 5) AS p99, round(quantile_cont(v, 0.999), 5) AS p99_9 FROM l GROUP BY 1""",
)
def c12(spark, sf_dir):
    df = T.log_returns(daily_panel(spark, sf_dir), (1,))
    out = C.describe(df, ["log_return_1", "close", "volume"], [0.01, 0.5, 0.99, 0.999])
    return rounded(out, ["column_name", "count"], 5)


@query(
    "c13_ticker_summary",
    f"WITH {DAILY} SELECT ticker, count(*) AS sessions, min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY 1",
)
def c13(spark, sf_dir):
    return C.ticker_summary(daily_panel(spark, sf_dir))


@query(
    "c14_drop_incomplete",
    f"""WITH {DAILY}, f AS (SELECT ticker, date, {full('avg', 'close', 50)} AS ma50, {lead('close', 5)} AS later FROM daily)
 SELECT ticker, date, round(ma50, 4) AS ma50, later FROM f WHERE ma50 IS NOT NULL AND later IS NOT NULL""",
)
def c14(spark, sf_dir):
    df = daily_panel(spark, sf_dir)
    df = df.withColumns({"ma50": T.DAILY.full(F.avg, F.col("close"), 50), "later": T.DAILY.lead(F.col("close"), 5)})
    return rounded(df.dropna("any", subset=["ma50", "later"]), [*KEY, "later"], 4, ["ma50"])


@query(
    "c15_subsample",
    f"""WITH {WIDE}, h AS (SELECT ticker, date, close,
  ('0x' || substr(md5(ticker || '|' || date || '|0'), 1, 13))::BIGINT AS d FROM wide)
 SELECT ticker, date, close FROM h QUALIFY row_number() OVER (ORDER BY d) <= 12000""",
)
def c15(spark, sf_dir):
    return C.subsample(wide_panel(spark, sf_dir), 12000, KEY).select(*KEY, "close")


@query(
    "c16_standardize",
    f"""WITH {DAILY}, {DATES}, t AS (SELECT avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv
  FROM daily JOIN dates USING (date) WHERE p < floor(0.8 * n))
 SELECT ticker, date, round((close - mc) / (sc + 1e-9), 6) AS close, round((volume - mv) / (sv + 1e-9), 6) AS volume FROM daily, t""",
)
def c16(spark, sf_dir):
    from barloom.operators.blocks import date_positions

    df = daily_panel(spark, sf_dir).select("ticker", "date", "close", "volume")
    early = date_positions(df, "date", "p", "n").filter("p < floor(0.8D * n)")
    scaler = C.fit_scaler(df.join(early, "date", "left_semi"), ["close", "volume"])
    return rounded(C.standardize(df, scaler, ["close", "volume"]), KEY, 6)


@query(
    "c17_recent_dates",
    f"WITH {DAILY}, {DATES} SELECT ticker, date, close FROM daily JOIN dates USING (date) WHERE p >= n - 504",
)
def c17(spark, sf_dir):
    return C.recent_dates(daily_panel(spark, sf_dir), 504).select(*KEY, "close")


@query(
    "c18_align_labels",
    f"""WITH {DAILY}, {DATES}, k AS (SELECT ticker, date FROM daily JOIN dates USING (date) WHERE p % 9 = 0),
 f AS (SELECT ticker, date, {lead('ln(close)', 5)} - ln(close) AS r5, {lead('ln(close)', 20)} - ln(close) AS r20 FROM daily)
 SELECT ticker, date, round(r5, 6) AS r5, round(r20, 6) AS r20 FROM k LEFT JOIN f USING (ticker, date)""",
)
def c18(spark, sf_dir):
    daily = daily_panel(spark, sf_dir)
    keys = C.date_stride(daily, 9).select(*KEY)
    values = L.forward_returns(daily, (5, 20), "r").select(*KEY, "r5", "r20")
    return rounded(C.align(keys, values, KEY), KEY, 6)
