"""Leak-free splits as role tables per date, and recency weights.

Roles depend on the date only, so they are worked out on the distinct dates
(calendar-sized) and reach the rows by an equi-join; rows are never multiplied
by folds before that join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.blocks import date_positions
from barloom.operators.ranking import with_ordinal


def walk_forward_folds(
    df: DataFrame,
    initial_years: int = 5,
    validation_years: int = 1,
    test_years: int = 1,
    step_years: int = 1,
    time: str = "date",
) -> DataFrame:
    """One row per expanding fold: six bounds and a name.

    Every year is added on its own, so 29 February settles on the 28th once it
    is passed, and the last fold ends at most one day after the last date.
    """
    span = df.agg(F.min(time).alias("first"), F.max(time).alias("last"))
    ids = F.explode(F.sequence(F.lit(0), F.floor(F.months_between("last", "first") / 12).cast("int"))).alias("fold")
    rows = span.select("first", "last", ids)

    def plus(start: Column, years: Column) -> Column:
        # The first step may leave 29 February, later ones cannot return to it.
        moved = F.add_months(F.add_months(start, 12), (years - 1) * 12)
        return F.when(years > 0, moved).otherwise(start)

    train_end = plus(F.col("first"), F.lit(initial_years) + F.col("fold") * step_years)
    rows = rows.select("fold", F.col("first").alias("train_start"), train_end.alias("train_end"), "last")
    rows = rows.withColumn("val_end", plus(F.col("train_end"), F.lit(validation_years)))
    rows = rows.withColumn("test_end", plus(F.col("val_end"), F.lit(test_years)))
    name = F.concat_ws("_to_", F.col("val_end").cast("string"), F.col("test_end").cast("string"))
    return rows.filter(F.col("test_end") <= F.date_add("last", 1)).select(
        "fold",
        name.alias("name"),
        "train_start",
        "train_end",
        F.col("train_end").alias("val_start"),
        "val_end",
        F.col("val_end").alias("test_start"),
        "test_end",
    )


def purged(time: Column, test_start: Column, test_end: Column, purge_days: int = 20, embargo_days: int = 20) -> Column:
    """True for rows outside the purge band before and the embargo band after a test range."""
    return (time < F.date_sub(test_start, purge_days)) | (time > F.date_add(test_end, embargo_days))


def walk_forward_roles(
    df: DataFrame, folds: DataFrame, purge_days: int = 20, embargo_days: int = 20, time: str = "date"
) -> DataFrame:
    """(date, fold, role) with role train / val / test; dates without a role are absent."""
    t = F.col(time)
    keep = purged(t, F.col("f.test_start"), F.col("f.test_end"), purge_days, embargo_days)
    role = (
        F.when((t >= F.col("f.test_start")) & (t < F.col("f.test_end")), "test")
        .when((t >= F.col("f.val_start")) & (t < F.col("f.val_end")), "val")
        .when((t >= F.col("f.train_start")) & (t < F.col("f.train_end")) & keep, "train")
    )
    table = folds.agg(F.collect_list(F.struct(*folds.columns))).scalar()
    dates = df.select(time).distinct()
    return (
        dates.select(time, F.explode(table).alias("f"))
        .select(time, F.col("f.fold").alias("fold"), role.alias("role"))
        .filter(F.col("role").isNotNull())
    )


def block_folds(
    df: DataFrame, n_splits: int = 5, purge: int = 1, min_train: int = 500, min_test: int = 50, time: str = "date"
) -> DataFrame:
    """(date, fold, role) of equal date blocks.

    Fold k trains on the dates before block k+1 less ``purge`` dates and tests on
    that block; the very last date is never tested.  Folds with too few rows are
    left out; row counts come from one count per date.
    """
    per_date = df.groupBy(time).agg(F.count(F.lit(1)).alias("__rows"))
    dates = date_positions(df, time, "__p", "__n").join(per_date, time)
    size = F.expr(f"__n div {n_splits + 1}")
    start = (F.col("fold") + 1) * size
    end = F.least((F.col("fold") + 2) * size, F.col("__n") - 1)
    role = F.when(F.col("__p") < F.greatest(F.lit(0), start - purge), "train").when(
        (F.col("__p") >= start) & (F.col("__p") < end), "test"
    )
    roles = dates.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    roles = roles.withColumn("role", role).filter("role is not null").select(time, "fold", "role", "__rows")
    big = (
        roles.groupBy("fold")
        .agg(
            F.sum(F.when(F.col("role") == "train", F.col("__rows"))).alias("a"),
            F.sum(F.when(F.col("role") == "test", F.col("__rows"))).alias("b"),
        )
        .filter((F.col("a") >= min_train) & (F.col("b") >= min_test))
    )
    return roles.join(big, "fold", "left_semi").select(time, "fold", "role")


def row_blocks(df: DataFrame, n_splits: int = 5, time: str = "date", ties: Sequence[str] = ("ticker",)) -> DataFrame:
    """Expanding split over rows in time order: adds ``row`` and ``block``.

    Row r belongs to block b (0 = never tested); fold k (1..n) tests block k and
    trains on the blocks before it.
    """
    numbered = with_ordinal(df.withColumn("__t", F.unix_date(time)), [], "__t", list(ties), "row").drop("__t")
    total = df.agg(F.count(F.lit(1))).scalar()
    size = F.floor(total / (n_splits + 1))
    first = total - n_splits * size
    block = F.when(F.col("row") <= first, 0).otherwise(F.floor((F.col("row") - first - 1) / size) + 1)
    return numbered.withColumn("block", block.cast("int"))


def cpcv_paths(
    df: DataFrame,
    n_groups: int = 6,
    n_test_groups: int = 2,
    embargo_frac: float = 0.01,
    purge: int = 1,
    time: str = "date",
) -> DataFrame:
    """(date, path, role): every choice of test blocks, purged and embargoed."""
    combos = list(combinations(range(n_groups), n_test_groups))
    dates = date_positions(df, time, "__p", "__n")
    p, n = F.col("__p"), F.col("__n")
    bound = lambda g: n if g == n_groups else F.floor(F.lit(g) * (n / F.lit(n_groups)))
    embargo = F.ceil(n * F.lit(embargo_frac))

    def member(g: int) -> Column:
        return (p >= bound(g)) & (p < bound(g + 1))

    def near(g: int) -> Column:
        low = F.greatest(F.lit(0), bound(g) - purge)
        high = F.least(n - 1, bound(g + 1) - 1 + embargo)
        return (p >= low) & (p <= high)

    roles = []
    for i, combo in enumerate(combos):
        test, close_by = F.lit(False), F.lit(False)
        for g in combo:
            test, close_by = test | member(g), close_by | near(g)
        role = F.when(test, "test").when(~close_by, "train")
        roles.append(F.struct(F.lit(i).alias("path"), role.alias("role")))
    return (
        dates.select(time, F.explode(F.array(*roles)).alias("r")).select(time, "r.*").filter("role is not null")
    )


def purged_holdout(df: DataFrame, fraction: float = 0.8, purge: int = 1, time: str = "date") -> DataFrame:
    """(date, role): test from the date at ``fraction`` on, train up to ``purge`` dates before it."""
    dates = date_positions(df, time, "__p", "__n")
    cut = F.floor(F.lit(fraction) * F.col("__n"))
    role = F.when(F.col("__p") >= cut, "test").when(F.col("__p") < F.greatest(F.lit(0), cut - purge), "train")
    return dates.select(time, role.alias("role")).filter("role is not null")


def purge_positions(horizon: int, stride: int) -> int:
    """Label reach in kept dates, rounded up."""
    return math.ceil(horizon / max(stride, 1))


def positional_split(df: DataFrame, fraction: float, ties: Sequence[str] = ("ticker",), time: str = "date") -> DataFrame:
    """Adds ``first_part``: whether the row is in the first int(n * fraction) rows by (time, ties)."""
    numbered = with_ordinal(df.withColumn("__t", F.unix_date(time)), [], "__t", list(ties), "__row").drop("__t")
    edge = F.floor(df.agg(F.count(F.lit(1))).scalar() * fraction)
    return numbered.withColumn("first_part", F.col("__row") <= edge).drop("__row")


def time_weights(df: DataFrame, decay: float = 2.0, time: str = "date") -> DataFrame:
    """Adds ``weight``: exp(-decay * (1 - age share)), mean 1 over the rows."""
    if decay == 0.0:
        return df.withColumn("weight", F.lit(1.0))
    span = df.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    raw = df.withColumn("__b", span).withColumn(
        "__w",
        F.exp(
            -F.lit(decay)
            * (
                1.0
                - F.date_diff(F.col(time), F.col("__b.lo"))
                / F.greatest(F.date_diff(F.col("__b.hi"), F.col("__b.lo")), F.lit(1))
            )
        ),
    )
    return raw.withColumn("weight", F.col("__w") / raw.agg(F.avg("__w")).scalar()).drop("__w", "__b")


def recent_weights(df: DataFrame, recent: float = 0.30, time: str = "date") -> DataFrame:
    """Adds ``weight``: 2 for the last ``recent`` share of dates, 1 before, mean 1 over the rows."""
    dates = date_positions(df, time, "__p", "__n")
    value = F.when(F.col("__p") >= F.floor(F.col("__n") * F.lit(1.0 - recent)), 2.0).otherwise(1.0)
    raw = df.join(dates.select(time, value.alias("__w")), time)
    return raw.withColumn("weight", F.col("__w") / raw.agg(F.avg("__w")).scalar()).drop("__w")


def development_window(df: DataFrame, fraction: float = 0.7, time: str = "date") -> DataFrame:
    """Rows up to and including the distinct date at ``fraction``."""
    kept = date_positions(df, time, "__p", "__n").filter(F.col("__p") <= F.floor(F.col("__n") * F.lit(fraction)))
    return df.join(kept, time, "left_semi")


def with_roles(df: DataFrame, roles: DataFrame, time: str = "date") -> DataFrame:
    """Rows with the roles of their date (one output row per fold the date is in)."""
    return df.join(roles, time)


