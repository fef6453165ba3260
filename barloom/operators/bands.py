"""Quantile bands, conformal widening, choices and the decision ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ranking import kth_smallest, quantiles

# Band levels and the ledger's columns.
TAUS = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
LEDGER_COLUMNS = {
    "ticker": "string",
    "date": "date",
    "horizon": "string",
    "p0": "double",
    "target": "double",
    "range_lo": "double",
    "range_hi": "double",
    "signal": "string",
    "call_strike": "double",
    "put_strike": "double",
    "band_lo_ret": "double",
    "band_hi_ret": "double",
    "actual": "double",
    "error": "double",
    "abs_error": "double",
    "pct_error": "double",
    "in_band": "boolean",
    "source": "string",
}


def empirical_bands(train: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    """Quantiles of the outcome per group; ordered by construction, so they cannot cross."""
    return quantiles(train, by, y, TAUS)


def conformity(y: Column, lo: Column, hi: Column) -> Column:
    return F.when(y.isNotNull(), F.greatest(lo - y, y - hi))


def conformal_rank(alpha: float) -> Column:
    """Index of the order statistic that gives 1 - alpha coverage, capped at n."""
    return F.least(F.ceil(F.lit(1.0 - alpha) * (F.col("total") + 1)), F.col("total"))


def conformal_delta(calibration: DataFrame, y: str, by: Sequence[str], alpha: float = 0.10) -> DataFrame:
    """One ``delta`` per group, never negative."""
    scored = calibration.withColumn("__s", conformity(F.col(y), F.col("q05"), F.col("q95")))
    kth = kth_smallest(scored, by, "__s", conformal_rank(alpha), "delta")
    return kth.select(*by, F.greatest("delta", F.lit(0.0)).alias("delta"))


def widen(bands: DataFrame, delta: DataFrame, by: Sequence[str]) -> DataFrame:
    """Move the two outer edges out by the group's delta."""
    joined = bands.join(delta, list(by), "left")
    d = F.coalesce(F.col("delta"), F.lit(0.0))
    return joined.withColumns({"q05": F.col("q05") - d, "q95": F.col("q95") + d}).drop("delta")


def choose(df: DataFrame, hold: float = 0.005) -> DataFrame:
    """Price target, range, signal and option strikes from a band (needs p0)."""
    p0 = F.col("p0")
    signal = F.when(F.col("q50") > hold, "buy").when(F.col("q50") < -hold, "sell").otherwise("hold")
    return df.withColumns(
        {
            "target": p0 * F.exp("q50"),
            "range_lo": p0 * F.exp("q05"),
            "range_hi": p0 * F.exp("q95"),
            "signal": signal,
            "call_strike": p0 * F.exp("q75"),
            "put_strike": p0 * F.exp("q25"),
            "band_lo_ret": F.col("q05"),
            "band_hi_ret": F.col("q95"),
        }
    )


def score(df: DataFrame) -> DataFrame:
    """Error of the target and membership of the range, against ``actual``."""
    a, t = F.col("actual"), F.col("target")
    return df.withColumns(
        {
            "error": a - t,
            "abs_error": F.abs(a - t),
            "pct_error": (a - t) / F.when(t.isNotNull(), F.greatest(t, F.lit(1e-9))),
            "in_band": (a >= F.col("range_lo")) & (a <= F.col("range_hi")),
        }
    )


def manual_choices(df: DataFrame) -> DataFrame:
    """Trader choices (ticker, date, horizon, p0, target, range_lo, range_hi, signal, actual) as ledger rows.

    A choice without an outcome keeps its error columns NULL.
    """
    staged = df.withColumns(
        {
            "band_lo_ret": F.log(F.col("range_lo") / F.col("p0")),
            "band_hi_ret": F.log(F.col("range_hi") / F.col("p0")),
            "source": F.lit("manual"),
        }
    )
    return as_ledger(score(staged))


def as_ledger(df: DataFrame) -> DataFrame:
    """The ledger's columns in order; missing ones are NULL."""
    cols = []
    for name, kind in LEDGER_COLUMNS.items():
        cols.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*cols)


LEDGER_KEY = ("ticker", "date", "horizon", "source")


def dedupe_last(df: DataFrame, order: str, key: Sequence[str] = LEDGER_KEY) -> DataFrame:
    """The row with the highest ``order`` per key.

    The window keeps one row per key while it reads, and Spark drops the others
    before the shuffle (row number <= 1 is pushed below the exchange).
    """
    newest = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(newest)).filter("__rn = 1").drop("__rn")


def append(ledger: DataFrame | None, rows: DataFrame, batch: int) -> DataFrame:
    """Union of the ledger and new rows; later batches win on the key.

    Both sides carry ``batch``, the number of the append.
    """
    new = as_ledger(rows).withColumn("batch", F.lit(batch))
    return new if ledger is None else ledger.unionByName(new, allowMissingColumns=True)


def coverage_by_ticker(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ticker").agg(F.avg(F.col("in_band").cast("double")).alias("coverage"))


def per_ticker_delta(ledger: DataFrame, alpha: float = 0.10, min_rows: int = 20) -> DataFrame:
    """Conformal widening per ticker from its own history; 0 below ``min_rows``."""
    ok = ledger.filter((F.col("p0") > 0) & (F.col("actual") > 0))
    y = F.log(F.col("actual") / F.col("p0"))
    scored = ok.withColumn("__s", conformity(y, F.col("band_lo_ret"), F.col("band_hi_ret")))
    kth = kth_smallest(scored, ["ticker"], "__s", conformal_rank(alpha), "__d")
    every = ledger.select("ticker").distinct().join(kth, "ticker", "left")
    return every.select(
        "ticker", F.when(F.col("n") >= min_rows, F.greatest(F.col("__d"), F.lit(0.0))).otherwise(0.0).alias("delta")
    )


def unpivot_horizons(df: DataFrame, keys: Sequence[str], horizons: Sequence[int], unit: str = "d") -> DataFrame:
    """Columns band{h} (struct of quantiles) and r{h} to one row per horizon with ``actual``.

    Rows without a price or an outcome are dropped.
    """
    parts = F.array(
        *[
            F.struct(F.lit(f"{h}{unit}").alias("horizon"), F.col(f"band{h}").alias("b"), F.col(f"r{h}").alias("r"))
            for h in horizons
        ]
    )
    long = df.select(*keys, "p0", F.explode(parts).alias("h"))
    out = long.select(*keys, F.col("h.horizon").alias("horizon"), "p0", "h.b.*", F.col("h.r").alias("r"))
    return out.withColumn("actual", F.col("p0") * F.exp("r")).dropna("any", subset=["p0", "actual"])


def batch_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("in_band").cast("double")).alias("in_band"),
        F.avg("abs_error").alias("mae"),
        F.avg(F.abs("pct_error")).alias("mpe"),
    )
