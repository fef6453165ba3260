"""Registered queries: sources, sinks, store.

Round trips go through the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cleaning as C
from barloom.operators import context as X
from barloom.operators import labels as L
from barloom.operators import metrics as M
from barloom.operators.ranking import with_ranks
from barloom.plans.registry import query, rounded
from barloom.plans.sqltext import DAILY, OVER, SECTOR, WIDE, lag, lead, r, rank_pct
from barloom.session import materialize, scratch_path
from barloom.sources import bars as S
from barloom.sources import news as N
from barloom.sources.datasets import daily_panel, sector_map, table, wide_panel
from barloom.sources.store import FeatureStore, LedgerTable, merge_scales, write_results

KEY = ["ticker", "date"]


def _csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "bars-csv")
    S.write_bars(daily_panel(spark, sf_dir).withColumnRenamed("close", "Close"), path)
    return path


@query("s01_read_bars", f"WITH {DAILY} SELECT CAST(ticker AS VARCHAR) AS ticker, date, open, high, low, close, volume FROM daily")
def s01(spark, sf_dir):
    out = S.read_bars(spark, _csv(spark, sf_dir))
    return out.select("ticker", "date", "open", "high", "low", "close", "volume")


@query("s01_mixed_headers", f"WITH {DAILY} SELECT CAST(ticker AS VARCHAR) AS ticker, date, open, high, low, close, volume FROM daily")
def s01_mixed(spark, sf_dir):
    """Files of two layouts below one folder: each is read by its own header."""
    root = scratch_path(spark, "mixed")
    bars = daily_panel(spark, sf_dir).select("ticker", "date", "open", "high", "low", "close", "volume")
    S.write_bars(bars.filter("ticker % 2 = 0"), f"{root}/even")
    turned = bars.filter("ticker % 2 = 1").select("ticker", "volume", "close", "low", F.col("date").alias("Date"), "high", F.col("open").alias(" OPEN"))
    S.write_bars(turned, f"{root}/odd")
    return S.read_bars(spark, root).select("ticker", "date", "open", "high", "low", "close", "volume")


@query("s02_list_available", f"WITH {DAILY} SELECT DISTINCT CAST(ticker AS VARCHAR) AS ticker FROM daily")
def s02(spark, sf_dir):
    return S.list_available(spark, _csv(spark, sf_dir))


@query(
    "s03_normalize_columns",
    f"WITH {DAILY} SELECT ticker, date, open, high, low, close, volume, close * 0.5::DOUBLE AS adj_close FROM daily",
)
def s03(spark, sf_dir):
    df = daily_panel(spark, sf_dir).withColumn(" Adj Close ", F.col("close") * 0.5)
    df = df.withColumnsRenamed({"open": "Open", "high": " HIGH", "close": "Close "})
    return S.normalize_columns(df).select(*KEY, "open", "high", "low", "close", "volume", "adj_close")


@query(
    "s04_coerce_dates",
    f"WITH {DAILY} SELECT ticker, date, CASE WHEN volume > 100 THEN -close ELSE close END AS close FROM daily",
)
def s04(spark, sf_dir):
    daily = daily_panel(spark, sf_dir).select("ticker", F.col("date").cast("string").alias("date"), "close", "volume")
    second = daily.filter("volume > 100").withColumn("close", -F.col("close"))
    both = daily.withColumn("seq", F.lit(1)).unionByName(second.withColumn("seq", F.lit(2)))
    return S.coerce_dates(both, "seq").select(*KEY, "close")


@query(
    "s05_load_universe",
    f"WITH {DAILY} SELECT CAST(ticker AS VARCHAR) AS ticker, date, close FROM daily WHERE ticker IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name >= 'ASIA')",
)
def s05(spark, sf_dir):
    regions = table(spark, sf_dir, "region").filter("r_name >= 'ASIA'")
    nations = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    wanted = nations.select(F.col("n_nationkey").cast("string").alias("ticker"))
    # A name without files is skipped.
    wanted = wanted.unionByName(wanted.select(F.concat(F.lit("NONE"), "ticker").alias("ticker")))
    return S.read_bars(spark, _csv(spark, sf_dir), wanted).select(*KEY, "close")


@query("s06_cache_round_trip", f"WITH {DAILY} SELECT ticker, date, close, volume FROM daily")
def s06(spark, sf_dir):
    path = scratch_path(spark, "cache")
    S.write_cache(daily_panel(spark, sf_dir).select(*KEY, "close", "volume"), path)
    return S.read_cache(spark, path)


@query(
    "s07_merge_missing",
    f"""WITH {DAILY}, {WIDE}, nw AS (SELECT ticker + 100 AS ticker, date, close FROM wide),
 g AS (SELECT t.ticker, c.date, n.close FROM (SELECT DISTINCT ticker FROM nw) t CROSS JOIN (SELECT DISTINCT date FROM daily) c LEFT JOIN nw n ON n.ticker = t.ticker AND n.date = c.date)
 SELECT ticker, date, close FROM daily UNION ALL
 SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM g""",
)
def s07(spark, sf_dir):
    cached = daily_panel(spark, sf_dir).select(*KEY, "close")
    new = wide_panel(spark, sf_dir).select((F.col("ticker") + 100).alias("ticker"), "date", "close")
    return S.merge_missing(cached, cached.unionByName(new))


_DENSE = """dt AS (SELECT DISTINCT date FROM daily), kp AS (SELECT ticker FROM daily GROUP BY 1 HAVING count(close) >= floor(0.7::DOUBLE * (SELECT count(*) FROM dt))),
 g AS (SELECT kp.ticker, dt.date, d.close, d.volume FROM kp CROSS JOIN dt LEFT JOIN daily d ON d.ticker = kp.ticker AND d.date = dt.date),
 f AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close,
  coalesce(last_value(volume IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS volume FROM g)"""


@query(
    "s08_dense_panel",
    f"WITH {DAILY}, {_DENSE} SELECT ticker, date, close FROM f WHERE date NOT IN (SELECT date FROM f WHERE close IS NULL)",
)
def s08(spark, sf_dir):
    return C.dense_panel(daily_panel(spark, sf_dir)).select(*KEY, "close")


@query("s08_dense_volume", f"WITH {DAILY}, {_DENSE} SELECT ticker, date, volume FROM f")
def s08_volume(spark, sf_dir):
    return C.dense_panel(daily_panel(spark, sf_dir), value="volume", fill_zero=True).select(*KEY, "volume")


@query(
    "s09_source_fallback",
    f"""WITH {DAILY}, {WIDE} SELECT ticker, date, close FROM daily UNION ALL SELECT ticker, date, close FROM wide
 WHERE ticker NOT IN (SELECT ticker FROM daily) AND ticker IN (SELECT ticker FROM wide GROUP BY 1 HAVING count(*) > 200)""",
)
def s09(spark, sf_dir):
    a = daily_panel(spark, sf_dir).select(*KEY, "close")
    return S.with_fallback(a, wide_panel(spark, sf_dir).select(*KEY, "close"))


@query("s10_normalize_symbols", "SELECT s_suppkey, trim(replace(s_name || '.' || s_nationkey || ' ', '.', '-')) AS symbol FROM supplier")
def s10(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.concat(F.lit("  "), "s_name", F.lit("."), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("symbol")
    )
    return S.normalize_symbols(df)


def news_json(spark, sf_dir):
    """Documents as news records in three shapes: ISO time, epoch time, nested."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ticker"), "text")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7 % 60).cast("int"))
    iso = F.concat(day.cast("string"), F.lit("T13:30:00Z"))
    epoch = F.unix_date(day).cast("long") * 86400 + 3600
    none = F.lit(None).cast("string")
    shape = F.col("doc_id") % 4
    record = (
        F.when(shape == 0, F.to_json(F.struct(iso.alias("pubDate"), F.col("text").alias("title"))))
        .when(shape == 1, F.to_json(F.struct(epoch.alias("providerPublishTime"), F.col("text").alias("headline"))))
        .when(shape == 2, F.to_json(F.struct(F.struct(iso.alias("pubDate"), F.col("text").alias("title")).alias("content"))))
        .otherwise(F.to_json(F.struct(none.alias("pubDate"), F.col("text").alias("title"))))
    )
    return d.select("doc_id", "ticker", record.alias("payload"))


_NEWS = "nw AS MATERIALIZED (SELECT doc_id, source AS ticker, CAST(DATE '2024-01-01' + CAST(doc_id * 7 % 60 AS INTEGER) AS DATE) AS date, text AS title FROM documents WHERE doc_id % 4 <> 3)"


@query("s11_flatten_news", f"WITH {_NEWS} SELECT doc_id, ticker, date, md5(title) AS title_md5, CAST(length(title) AS INTEGER) AS n FROM nw")
def s11(spark, sf_dir):
    flat = N.flatten_news(news_json(spark, sf_dir), "payload", ("doc_id", "ticker"))
    return flat.select("doc_id", "ticker", "date", F.md5("title").alias("title_md5"), F.length("title").alias("n"))


# A user lexicon for the checks; valences are multiples of 1/8, so sums are exact.
LEXICON = (("the", 0.5), ("of", -0.375), ("and", 0.25), ("by", -0.625), ("le", 0.125), ("la", -0.25), ("un", 0.75), ("der", 1.0), ("que", -0.5))
_LEX = "lx(word, valence) AS (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON) + ")"
_SCORE = f"""{_LEX}, tk AS (SELECT doc_id, unnest(regexp_split_to_array(lower(title), '[^\\p{{L}}]+')) AS word FROM nw),
 sm AS (SELECT doc_id, sum(valence) AS s FROM tk JOIN lx USING (word) GROUP BY 1),
 so AS MATERIALIZED (SELECT nw.doc_id, ticker, date, coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15) AS score FROM nw LEFT JOIN sm USING (doc_id))"""


def news_scores(spark, sf_dir):
    lexicon = spark.createDataFrame(list(LEXICON), "word string, valence double")
    flat = N.flatten_news(news_json(spark, sf_dir), "payload", ("doc_id", "ticker"))
    return N.lexicon_scores(flat, "title", lexicon, ("doc_id", "ticker", "date"))


@query(
    "s12_lexicon_scores",
    f"""WITH {_LEX}, tk AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS word FROM documents),
 sm AS (SELECT doc_id, sum(valence) AS s FROM tk JOIN lx USING (word) GROUP BY 1)
 SELECT doc_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15), 6) AS score FROM documents LEFT JOIN sm USING (doc_id)""",
)
def s12(spark, sf_dir):
    lexicon = spark.createDataFrame(list(LEXICON), "word string, valence double")
    return rounded(N.lexicon_scores(table(spark, sf_dir, "documents"), "text", lexicon, ("doc_id",)), ["doc_id"], 6, ["score"])


@query(
    "s13_sentiment_panel",
    f"""WITH {_NEWS}, {_SCORE}, m AS (SELECT ticker, date, avg(score) AS score FROM so GROUP BY 1, 2),
 g AS (SELECT ticker, date FROM (SELECT DISTINCT source AS ticker FROM documents), (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events))
 SELECT ticker, date, round(coalesce(last_value(score IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0), 6) AS score FROM g LEFT JOIN m USING (ticker, date)""",
)
def s13(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"))
    tickers = table(spark, sf_dir, "documents").select(F.col("source").alias("ticker")).distinct()
    grid = tickers.select("ticker", F.explode(days.agg(F.collect_set("date")).scalar()).alias("date"))
    return rounded(N.sentiment_panel(news_scores(spark, sf_dir), grid), KEY, 6)


# ---- store -------------------------------------------------------------------

_STF = f"""w1 AS MATERIALIZED (SELECT ticker, date, ln(close) - {lag('ln(close)')} AS a, close / {lag('close', 5)} - 1 AS b, {lead('ln(close)', 1)} - ln(close) AS f1, {lead('ln(close)', 5)} - ln(close) AS f5 FROM wide),
 st AS MATERIALIZED (SELECT ticker, date, a, b, 1 AS horizon, CASE WHEN {rank_pct('f1', 'date')} <= 0.2::DOUBLE THEN 0 WHEN {rank_pct('f1', 'date')} >= 0.8::DOUBLE THEN 1 END AS label FROM w1 WHERE b IS NOT NULL AND f1 IS NOT NULL
  UNION ALL SELECT ticker, date, a, b, 5, CASE WHEN {rank_pct('f5', 'date')} <= 0.2::DOUBLE THEN 0 WHEN {rank_pct('f5', 'date')} >= 0.8::DOUBLE THEN 1 END FROM w1 WHERE b IS NOT NULL AND f5 IS NOT NULL)"""


def store_rows(spark, sf_dir, *horizons: int):
    """Rows of each horizon with their label, as tables: panel and ranks are worked out once, however often they are written."""
    ax = L.DAILY
    c = F.col("close")
    ahead = [L.forward_return(h).alias(f"fwd{h}") for h in horizons]
    df = wide_panel(spark, sf_dir).select(*KEY, ax.log_return(c).alias("a"), (c / ax.lag(c, 5) - 1).alias("b"), *ahead)
    df = materialize(df.filter("b is not null"), "store-panel")
    out = []
    for h in horizons:
        rows = df.select(*KEY, "a", "b", F.col(f"fwd{h}").alias("fwd")).dropna("any", subset=["b", "fwd"])
        out.append(materialize(L.top_bottom_by_rank(rows, "fwd").drop("fwd"), "store-rows"))
    return out


def filled_store(spark, sf_dir) -> FeatureStore:
    """Horizon 5 is written twice; the second batch negates a and must win."""
    store = FeatureStore(spark, scratch_path(spark, "store"))
    one, five = store_rows(spark, sf_dir, 1, 5)
    store.upsert(one, ["a", "b"], "label", 1)
    store.upsert(five, ["a", "b"], "label", 5)
    store.upsert(five.withColumn("a", -F.col("a")), ["a", "b"], "label", 5)
    return store


VEC_SQL = "SELECT CAST(ticker AS VARCHAR) AS ticker, date, CAST(horizon AS INTEGER) AS horizon, round(CASE WHEN horizon = 5 THEN -a ELSE a END, 6) AS v0, round(b, 6) AS v1, label FROM st"


STORE_SQL = f"WITH {WIDE}, {_STF}"


def vector_columns(df):
    v = F.col("vec")
    return df.select(
        "ticker", "date", F.col("horizon").cast("int").alias("horizon"), F.round(v[0], 6).alias("v0"),
        F.round(v[1], 6).alias("v1"), F.col("label").cast("int").alias("label"),
    )


@query("s14_store_upsert", f"WITH {WIDE}, {_STF} {VEC_SQL}")
def s14(spark, sf_dir):
    return vector_columns(filled_store(spark, sf_dir).current())


@query(
    "s15_store_range",
    f"WITH {WIDE}, {_STF} {VEC_SQL} WHERE horizon = 5 AND label IS NOT NULL AND date >= DATE '1996-01-01' AND date < DATE '1998-01-01'",
)
def s15(spark, sf_dir):
    return vector_columns(filled_store(spark, sf_dir).load_range(5, "1996-01-01", "1998-01-01"))


@query(
    "s16_store_summary",
    f"WITH {WIDE}, {_STF} SELECT CAST(horizon AS INTEGER) AS horizon, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM st WHERE label IS NOT NULL GROUP BY 1",
)
def s16(spark, sf_dir):
    return filled_store(spark, sf_dir).summary().withColumn("horizon", F.col("horizon").cast("int"))


def _matrix_sql(h: int) -> str:
    from barloom.operators.technicals import MODULAR
    from barloom.plans.q_technicals import MODULAR_CTE

    whole = " AND ".join(f"{c} IS NOT NULL" for c in MODULAR)
    cte = MODULAR_CTE.replace("AS fwd FROM moves", f"AS fwd1, {lead('ln(close)', 20)} - ln(close) AS fwd20 FROM moves")
    one = lambda k: (
        f"SELECT {k} AS horizon, ticker, date, {rank_pct('ret20', 'date')} AS x, {rank_pct('vol60', 'date')} AS z, {rank_pct(f'fwd{k}', 'date')} AS p"
        f" FROM md WHERE n_rows >= 300 AND fwd{k} IS NOT NULL AND {whole}"
    )
    return f"""WITH {DAILY}, {cte}, k AS ({one(1)} UNION ALL {one(20)})
 SELECT horizon, CAST(ticker AS VARCHAR) AS ticker, date, round(x, 6) AS ret20, round(z, 6) AS vol60, CASE WHEN p <= 0.2::DOUBLE THEN 0 ELSE 1 END AS label FROM k WHERE p <= 0.2::DOUBLE OR p >= 0.8::DOUBLE"""


@query("s17_build_store", _matrix_sql(20))
def s17(spark, sf_dir):
    from barloom.operators.technicals import MODULAR
    from barloom.plans.matrix import build_store

    store = FeatureStore(spark, scratch_path(spark, "store"))
    build_store(daily_panel(spark, sf_dir), (1, 20), store)
    v = F.col("vec")
    return store.current().select(
        F.col("horizon").cast("int").alias("horizon"),
        "ticker",
        "date",
        F.round(v[MODULAR.index("ret20")], 6).alias("ret20"),
        F.round(v[MODULAR.index("vol60")], 6).alias("vol60"),
        F.col("label").cast("int").alias("label"),
    )


@query(
    "s18_result_sinks",
    f"""WITH {DAILY}, s AS (SELECT ticker, count(*) AS n, sum(volume) AS volume FROM daily GROUP BY 1)
 SELECT 'csv' AS kind, ticker, n, volume FROM s UNION ALL SELECT 'parquet', ticker, n, volume FROM s""",
)
def s18(spark, sf_dir):
    df = daily_panel(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
    out = []
    for kind in ("csv", "parquet"):
        path = scratch_path(spark, kind)
        write_results(df, path, kind)
        reader = spark.read.schema(df.schema).option("header", "true")
        back = reader.csv(path) if kind == "csv" else reader.parquet(path)
        out.append(back.withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


@query(
    "s19_json_merge",
    f"""WITH {DAILY}, {WIDE}, m AS (SELECT 'd' AS label, 1.0::DOUBLE AS days, avg(close) AS mean_close FROM daily UNION ALL SELECT 'w', 5.0, avg(close) FROM wide) SELECT label, days, round(mean_close, 4) AS mean_close FROM m""",
)
def s19(spark, sf_dir):
    parts = []
    for label, days, df in (("w", 5.0, wide_panel(spark, sf_dir)), ("d", 1.0, daily_panel(spark, sf_dir))):
        path = scratch_path(spark, "json")
        one = df.agg(F.avg("close").alias("mean_close")).select(
            F.lit(label).alias("label"), F.lit(days).alias("days"), F.round("mean_close", 4).alias("mean_close")
        )
        write_results(one, path, "json")
        parts.append(spark.read.schema(one.schema).json(path))
    return merge_scales(*parts)


@query(
    "s20_sector_map",
    f"""WITH {WIDE}, {SECTOR}, t AS (SELECT DISTINCT ticker FROM wide) SELECT t.ticker, coalesce(CAST(sector AS VARCHAR), 'MARKET') AS sector FROM t LEFT JOIN sector ON sector.ticker = t.ticker""",
)
def s20(spark, sf_dir):
    tickers = wide_panel(spark, sf_dir).select("ticker").distinct()
    return X.with_sector(tickers, sector_map(spark, sf_dir)).select("ticker", "sector")
