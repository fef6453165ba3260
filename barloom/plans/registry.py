"""Registered queries and the SQL texts that check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, keep: list[str], digits: dict[str, int] | int = 6, only: list[str] | None = None) -> DataFrame:
    """Select keys as they are and numbers rounded, NaN as NULL."""
    cols: list[Column] = [F.col(k) for k in keep]
    for name in only or [c for c in df.columns if c not in keep]:
        d = digits if isinstance(digits, int) else digits.get(name, 6)
        cols.append(F.round(F.col(name), d).alias(name))
    return df.select(*cols)
