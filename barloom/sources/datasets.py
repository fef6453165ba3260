"""Panels derived from the star-schema and event tables.

Prices are built from integer cents and integer units, so sums do not depend on
the order tasks finish in.  No join is hinted: Spark broadcasts ``supplier``
while its size allows and falls back to a skew-aware sort-merge join beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bar_columns() -> list[Column]:
    unit = F.col("l_extendedprice") / F.col("l_quantity") * 10000
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    units = F.col("l_quantity").cast("long")
    return [
        (F.sum(F.floor(unit)) / F.count(F.lit(1)) / 10000).alias("open"),
        (F.max(F.ceil(unit)) / F.lit(10000.0)).alias("high"),
        (F.min(F.floor(unit)) / F.lit(10000.0)).alias("low"),
        (F.sum(cents) / F.sum(units) / 100).alias("close"),
        F.sum(units).cast("double").alias("volume"),
    ]


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per nation of the supplier: few tickers, long history."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ticker"))
    joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return joined.groupBy("ticker", F.col("l_shipdate").cast("date").alias("date")).agg(*_bar_columns())


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: many tickers, short history."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lines.groupBy(
        F.col("l_suppkey").cast("int").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(*_bar_columns())


def market_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per date over all line items."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_shipdate")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(*_bar_columns())


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    return nations.select(F.col("n_nationkey").alias("ticker"), F.col("n_regionkey").alias("sector"))


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type."""
    cents = F.round(F.col("value") * 100).cast("long")
    return (
        table(spark, sf_dir, "events")
        .filter("value > 0")
        .groupBy(F.col("event_type").alias("ticker"), F.date_trunc("hour", F.col("ts")).alias("ts"))
        .agg(
            (F.sum(cents) / F.count(F.lit(1)) / 100).alias("close"),
            (F.max(cents) / F.lit(100.0)).alias("high"),
            (F.min(cents) / F.lit(100.0)).alias("low"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )
