"""Row positions and bounded-window blocks for series of unlimited length.

A timestamped series (one ticker of tick or minute bars) can hold a large share
of all rows.  ``with_position`` numbers its rows from per-chunk counts, and
``blocked`` cuts it into blocks that carry the rows a window needs from the
neighbouring block, so every window runs on (keys, block) partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import Axis

BLOCK = "__block"
CHUNK = "__chunk"
SPAN_SECONDS = 86_400


def time_chunk(df: DataFrame, time: str) -> Column:
    """A coarse, order-preserving chunk of the time column: a day, or 1 024 days of dates."""
    if dict(df.dtypes)[time] == "date":
        return F.floor(F.unix_date(F.col(time)) / 1024).cast("long")
    return F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / SPAN_SECONDS).cast("long")


def with_position(df: DataFrame, ax: Axis, out: str) -> DataFrame:
    """Add the 0-based position inside the series without one task per series.

    Rows are numbered inside (keys, chunk); the chunk offsets come from counts.
    """
    staged = df.withColumn(CHUNK, time_chunk(df, ax.time))
    along = Window.partitionBy(*ax.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*ax.keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*ax.keys, CHUNK, F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*ax.keys, CHUNK).orderBy(ax.time)
    return (
        staged.join(offsets, [*ax.keys, CHUNK])
        .withColumn(out, F.col("__before") + F.row_number().over(inside) - 1)
        .drop(CHUNK, "__before")
    )


def blocked(df: DataFrame, ax: Axis, back: int, ahead: int = 0, pos: str = "pos") -> tuple[DataFrame, Axis]:
    """Cut every series into blocks with ``back`` / ``ahead`` neighbour rows.

    Returns the frame with a block key and ``__own`` (false on borrowed rows),
    and the axis to put windows on.  Call ``owned`` after the windows.  A block is at
    least eight times the borrowed rows, so borrowing adds at most a quarter.
    """
    size = max(4096, 8 * max(back, ahead, 1))
    staged = with_position(df, ax, pos)
    block = F.expr(f"{pos} div {size}")
    offset = F.expr(f"{pos} % {size}")
    homes = [block]
    if back:
        homes.append(F.when(offset >= size - back, block + 1))
    if ahead:
        homes.append(F.when((offset < ahead) & (block > 0), block - 1))
    staged = staged.withColumn("__home", block).withColumn(
        BLOCK, F.explode(F.filter(F.array(*homes), lambda b: b.isNotNull()))
    )
    staged = staged.withColumn("__own", F.col("__home") == F.col(BLOCK)).drop("__home")
    return staged, Axis((*ax.keys, BLOCK), pos)


def owned(df: DataFrame) -> DataFrame:
    """Drop borrowed rows and the block key."""
    return df.filter("__own").drop("__own", BLOCK)


def running_sum(df: DataFrame, ax: Axis, x: str, out: str) -> DataFrame:
    """Cumulative sum along a series, two-level (chunk totals, then inside)."""
    staged = df.withColumn(CHUNK, time_chunk(df, ax.time))
    along = Window.partitionBy(*ax.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*ax.keys, CHUNK)
        .agg(F.sum(x).alias("__s"))
        .select(*ax.keys, CHUNK, F.coalesce(F.sum("__s").over(along), F.lit(0.0)).alias("__before"))
    )
    inside = Window.partitionBy(*ax.keys, CHUNK).orderBy(ax.time).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.join(offsets, [*ax.keys, CHUNK])
        .withColumn(out, F.col("__before") + F.sum(x).over(inside))
        .drop(CHUNK, "__before")
    )


def date_positions(df: DataFrame, time: str, out: str = "date_pos", total: str | None = None) -> DataFrame:
    """Distinct times with their 0-based position; optional column with their number.

    Dates are at most one row per calendar day, so one ordered window holds them.
    Timestamps are numbered per day chunk, plus the counts of earlier chunks.
    """
    times = df.select(time).distinct()
    if dict(df.dtypes)[time] == "date":
        cols = {out: (F.row_number().over(Window.orderBy(time)) - 1).cast("long")}
        if total:
            cols[total] = F.count(F.lit(1)).over(Window.partitionBy())
        return times.withColumns(cols)
    staged = times.withColumn(CHUNK, time_chunk(times, time))
    along = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            CHUNK,
            F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"),
            F.sum("__n").over(Window.partitionBy()).alias("__all"),
        )
    )
    inside = Window.partitionBy(CHUNK).orderBy(time)
    out_df = staged.join(offsets, CHUNK).withColumn(out, F.col("__before") + F.row_number().over(inside) - 1)
    if total:
        out_df = out_df.withColumn(total, F.col("__all"))
    return out_df.drop(CHUNK, "__before", "__all")
