"""The ranked, labelled feature matrix, and the multi-horizon store built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.expr import DAILY, Axis
from barloom.operators import labels as L
from barloom.operators.cleaning import date_stride
from barloom.operators.context import (
    CONTEXT_HORIZONS,
    MACRO_HORIZONS,
    hierarchical_context,
    scale_macro,
)
from barloom.operators.extended import EXTENDED, extended_features
from barloom.operators.ranking import with_ranks
from barloom.operators.technicals import MODULAR, modular_features
from barloom.session import materialize
from barloom.sources.store import FeatureStore


def raw_features(
    bars: DataFrame,
    sectors: DataFrame | None = None,
    extended: bool = False,
    min_history: int = 300,
    ax: Axis = DAILY,
) -> tuple[DataFrame, list[str], list[str]]:
    """Unranked features with close; names to rank and names to scale over time."""
    df = modular_features(bars, ax, min_history)
    ranked, macro = list(MODULAR), []
    if extended:
        df = extended_features(df, ax)
        ranked += EXTENDED
    if sectors is not None:
        df = hierarchical_context(df, sectors, ax)
        ranked += [f"{p}{h}" for h in CONTEXT_HORIZONS for p in ("rs_sector", "rs_market", "sector_vs_market")]
        macro = [f"{p}{h}" for h in MACRO_HORIZONS for p in ("macro_trend", "macro_vol")]
    return df, ranked, macro


def feature_matrix(
    bars: DataFrame | None,
    horizon: int = 1,
    target: str = "return",
    top: float = 0.2,
    bottom: float = 0.2,
    stride: int = 1,
    sectors: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    extended: bool = False,
    min_history: int = 300,
    ax: Axis = DAILY,
    raw: tuple[DataFrame, list[str], list[str]] | None = None,
) -> tuple[DataFrame, list[str]]:
    """(ticker, date, label, features in (0, 1]) and the feature names.

    ``raw`` takes the result of ``raw_features`` when several horizons share it.

    Incomplete rows go before ranking, so they do not count in the ranks.
    ``target``: return and vol give top/bottom labels, quantile the forward return.
    """
    df, ranked, macro = raw or raw_features(bars, sectors, extended, min_history, ax)
    if sentiment is not None:
        df = df.join(sentiment.select(*ax.keys, ax.time, F.col("score").alias("sent")), [*ax.keys, ax.time], "left")
        df = df.withColumn("sent", F.coalesce("sent", F.lit(0.0)))
    if target == "vol":
        df = df.withColumn("__r1", ax.log_return(F.col("close")))
        df = df.withColumn("fwd", L.forward_volatility(F.col("__r1"), horizon, ax)).drop("__r1")
    else:
        df = df.withColumn("fwd", L.forward_return(horizon, ax))
    extra = ["sent"] if sentiment is not None else []
    df = df.select(*ax.keys, ax.time, *ranked, *macro, *extra, "fwd")
    df = df.dropna("any", subset=[*ranked, *macro, "fwd"])
    out = {c: c for c in ranked} | ({"sent_rank": "sent"} if extra else {})
    renamed = df.withColumnsRenamed({c: f"__raw_{c}" for c in ranked})
    spec = {o: (f"__raw_{x}" if x in ranked else x) for o, x in out.items()}
    if target != "quantile":
        spec["__fwd_rank"] = "fwd"
    df = with_ranks(renamed, [ax.time], spec)
    if macro:
        df = scale_macro(df, macro, time=ax.time)
    label = F.col("fwd") if target == "quantile" else L.split_by_rank(F.col("__fwd_rank"), top, bottom)
    names = [*ranked, *macro, *(["sent_rank"] if extra else [])]
    df = df.select(*ax.keys, ax.time, label.alias("label"), *names).filter("label is not null")
    return (date_stride(df, stride, ax.time) if stride > 1 else df), names


def build_store(
    bars: DataFrame, horizons: Sequence[int], store: FeatureStore
) -> FeatureStore:
    """One batch per horizon; every horizon prunes to its own folder.

    The indicators are computed once into a table; each horizon only adds its
    label, drops incomplete rows and ranks.
    """
    df, ranked, macro = raw_features(bars)
    table = materialize(df.select("ticker", "date", "close", *ranked, *macro), "features")
    for h in horizons:
        matrix, names = feature_matrix(None, horizon=h, raw=(table, ranked, macro))
        store.upsert(matrix, names, "label", h)
    return store
