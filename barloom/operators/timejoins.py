"""Joins of timestamped tables: the last row before, and overlapping intervals.

Both cut time into buckets, so a key that has a third of all rows is many tasks' work, and
neither compares rows of a key with each other one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def _micros(c: Column) -> Column:
    """A timestamp or date as microseconds."""
    return F.unix_micros(c.cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    tolerance: float | None = None,
    bucket: float = 86_400.0,
    prefix: str = "asof_",
) -> DataFrame:
    """Every row of ``left`` with the latest row of ``right`` at or before its time, by key.

    Adds the columns of ``right`` but the keys, under ``prefix``; NULL where there is no such row, it is
    older than ``tolerance`` seconds, or a key or the time is NULL.  Of right rows at one time the one with the
    greatest values (columns in order, NULL least) is taken; right rows without a time are no match.

    Rows of both sides go into one table, and the last right row is carried along each
    (key, bucket of time) in order.  Each bucket that has left rows also gets a copy of the last right
    row of the buckets before it, found on one row per bucket.  ``bucket`` (seconds) bounds the
    rows that one sort holds; it changes no result.  No row is multiplied.
    """
    keys, own = list(keys), [c for c in right.columns if c not in keys]
    at, size = "__at", int(bucket * MICROS)
    values = F.struct(*(F.col(c) for c in own))
    kind = F.struct(_micros(F.col(time)).alias("at"), values.alias("row"))
    carried = right.filter(F.col(time).isNotNull()).select(*keys, kind.alias("__r"))
    carried = carried.withColumn(at, F.col("__r.at")).withColumn("__b", F.floor(F.col(at) / size))
    rows = left.select(*keys, F.struct(*(F.col(c) for c in left.columns)).alias("__l"), _micros(F.col(time)).alias(at))
    rows = rows.withColumn("__b", F.floor(F.col(at) / size))

    # One row per key and bucket: the last right row, and whether left rows ask for an earlier one.
    marks = carried.select(*keys, "__b", "__r").unionByName(
        rows.filter(F.col(at).isNotNull()).select(*keys, "__b"), allowMissingColumns=True
    )
    asked = F.max(F.col("__r").isNull())
    ends = marks.groupBy(*keys, "__b").agg(F.max("__r").alias("__r"), asked.alias("__asked"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    lent = ends.withColumn("__r", F.last("__r", ignorenulls=True).over(before)).filter("__asked and __r is not null")
    lent = lent.select(*keys, "__b", "__r", F.col("__r.at").alias(at))

    both = carried.unionByName(lent).unionByName(rows, allowMissingColumns=True)
    along = Window.partitionBy(*keys, "__b").orderBy(at, F.col("__l").isNotNull(), "__r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__r", F.last("__r", ignorenulls=True).over(along)).filter("__l is not null")
    whole = F.col(at).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    if tolerance is not None:
        whole = whole & (F.col(at) - F.col("__r.at") <= int(tolerance * MICROS))
    return found.withColumn("__r", F.when(whole, F.col("__r"))).select(
        "__l.*", *(F.col(f"__r.row.{c}").alias(f"{prefix}{c}") for c in own)
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    fan: int = 16,
    finest: float = 60.0,
) -> DataFrame:
    """Pairs of rows of equal keys whose half-open intervals [start, end) overlap.

    Columns: the keys, then the other columns of both sides, whose names must differ.  A span whose start and
    end are the same column is a point in time.  Empty intervals, and rows with a NULL key or bound, have no pair.

    Buckets double as a ladder: an interval goes to the first rung (``finest`` seconds, times ``fan`` per
    rung) on which it meets at most ``fan`` + 1 buckets, so long intervals are not cut into many rows.
    The two sides meet by equal keys, rung and bucket, on every rung that both can reach; a pair that meets in
    several buckets is kept in the later one of the two first buckets only.
    """
    keys = list(keys)

    def spans(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        low, high = _micros(F.col(span[0])), _micros(F.col(span[1]))
        high = low + 1 if span[0] == span[1] else high
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
        out = df.select(*keys, row.alias(f"__{side}"), low.alias(f"__{side}0"), high.alias(f"__{side}1"))
        length = F.col(f"__{side}1") - F.col(f"__{side}0")
        rung = F.greatest(F.lit(0), F.ceil(F.log(length / (fan * finest * MICROS)) / F.log(F.lit(float(fan))))).cast("int")
        return out.filter(whole & (length > 0)).withColumn(f"__{side}r", rung)

    a, b = spans(left, left_span, "a"), spans(right, right_span, "b")
    # One row: the rungs in use, at most a dozen.
    rungs = a.select(F.col("__ar").alias("r")).union(b.select("__br")).agg(F.array_sort(F.collect_set("r"))).first()[0] or []
    width = lambda r: int(finest * MICROS) * fan**r

    def dealt(df: DataFrame, side: str) -> DataFrame:
        """Each row on its own rung and on all higher ones in use, once per bucket it meets."""

        def cut(r: int) -> Column:
            first, last = F.floor(F.col(f"__{side}0") / width(r)), F.floor((F.col(f"__{side}1") - 1) / width(r))
            buckets = F.transform(F.sequence(first, last), lambda x: F.struct(F.lit(r).alias("__r"), x.alias("__k")))
            return F.when(F.col(f"__{side}r") <= r, buckets)

        parts = [cut(r) for r in rungs]
        some = F.flatten(F.array_compact(F.array(*parts)))
        return df.select("*", F.inline(some)) if parts else df.withColumns({"__r": F.lit(0), "__k": F.lit(0).cast("long")})

    # The pair meets on the higher of the two rungs; there each side is cut as that rung cuts it.
    met = dealt(a, "a").join(dealt(b, "b"), [*keys, "__r", "__k"])
    scale = F.element_at(F.create_map(*(F.lit(v) for r in rungs or [0] for v in (r, width(r)))), F.col("__r"))
    met = met.filter(
        (F.col("__r") == F.greatest("__ar", "__br"))
        & (F.col("__a0") < F.col("__b1"))
        & (F.col("__b0") < F.col("__a1"))
        & (F.col("__k") == F.floor(F.greatest("__a0", "__b0") / scale))
    )
    return met.select(*keys, "__a.*", "__b.*")
