"""Exact ranks, quantiles and order statistics of groups of any size.

Ranks of groups that a task can sort (a million rows) are windows on the rows.  Beyond that, and for quantiles, a group
is cut into ranges of values, as many as its rows ask for; only the sizes of
ranges are added up per group, and the sort runs per (group, range).  The cuts come from
a sample of the group drawn by hash, so they lie where the values lie, however crowded, and
a repeated evaluation finds the same ones.  A group holding a third of all rows is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

# Rows that one range is meant to hold; a group has at most RANGES of them.
RANGE_VALUES = 16_384
RANGES = 256
# A group of so many ranges at most is ranked by one task.
WHOLE_RANGES = 64
# Sampled values of a group from which its cuts are taken.
SAMPLED = 4096

# Buckets per factor e of magnitude; about 2 800 per factor 2.
RESOLUTION = 4096.0


def order_bucket(x: Column) -> Column:
    """A non-decreasing integer function of a double.

    Logarithmic on both sides of zero, so it needs no pass over the data to find
    a range and keeps resolution for tiny and for huge values alike.
    """
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * 1e9) * RESOLUTION).cast("long")


def _equal(names: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality of the columns of two aliased frames."""
    return all_of([F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names] or [F.lit(True)])


def ranged_values(values: DataFrame, by: Sequence[str], x: str, draw: str, n: Column) -> DataFrame:
    """Add ``__part``: the range of x in its group, numbered in order of x; odd ones hold one value only.

    ``draw`` names the column whose hash draws the sample, ``n`` says how many rows a row stands
    for.  A value that fills much of a group is itself a cut, and every cut is a range of its own.
    """
    sizes = values.groupBy(*by).agg(F.sum(n).alias("__size")).filter(F.col("__size") > RANGE_VALUES)
    drawn = values.alias("v").join(sizes.alias("s"), _equal(by, "v", "s")).filter(
        F.pmod(F.xxhash64(f"v.{draw}"), F.col("__size")) < SAMPLED * n
    )
    keys = [F.col(f"v.{c}").alias(c) for c in by]
    lists = drawn.select(*keys, F.col(f"v.{x}").alias("__x"), "__size").groupBy(*by).agg(
        F.sort_array(F.collect_list("__x")).alias("__all"), F.max("__size").alias("__size")
    ).filter("__size is not null")
    ranges = F.least(F.lit(RANGES), F.ceil(F.col("__size") / RANGE_VALUES)).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(1), F.col("__ranges") - 1),
        lambda i: F.get(F.col("__all"), F.floor(i * F.size("__all") / F.col("__ranges")).cast("int")),
    )
    lists = lists.withColumn("__ranges", ranges).select(*by, F.array_distinct(cuts).alias("__cuts"))
    v = F.col(f"v.{x}")
    under = F.size(F.filter("__cuts", lambda c: c < v))
    at = F.when(F.col("__cuts").isNull(), 0).otherwise(2 * under + F.array_contains("__cuts", v).cast("int"))
    found = values.alias("v").join(lists.alias("c"), _equal(by, "v", "c"), "left")
    return found.select("v.*", at.alias("__part"))


def _before(ranged: DataFrame, by: Sequence[str], n: Column) -> DataFrame:
    """Per range of a group: ``__before`` (rows in lower ranges), ``__held`` (its own) and ``total`` (the group's)."""
    along = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__part")
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    return (
        ranged.groupBy(*by, "__part")
        .agg(F.sum(n).alias("__held"))
        .select(
            *by,
            "__part",
            "__held",
            (F.sum("__held").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__held")).alias("__before"),
            F.sum("__held").over(whole).alias("total"),
        )
    )


def value_ranks(df: DataFrame, by: Sequence[str], x: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct non-null value of each group.

    Columns: by, x, ``n`` (copies), ``below`` (rows with a smaller value),
    ``total`` (rows in the group) and the ``extra`` aggregates of the copies.
    """
    by = list(by)
    extra = extra or {}
    counted = (
        df.filter(F.col(x).isNotNull())
        .groupBy(*by, x)
        .agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in extra.items()])
    )
    values = ranged_values(counted, by, x, x, F.col("n"))
    keys = [*by, "__part"]
    inside = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("__inside", F.sum("n").over(inside) - F.col("n")).alias("v")
    base = _before(values, by, F.col("n")).alias("b")
    return ranked.join(base, _equal(keys, "v", "b")).select(
        *(F.col(f"v.{c}").alias(c) for c in [*by, x, "n"]),
        (F.col("__before") + F.col("__inside")).alias("below"),
        "total",
        *extra,
    )


def average_rank() -> Column:
    """Tie-averaged 1-based rank of a ``value_ranks`` row."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def with_rank(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    out: str,
    pct: bool = False,
) -> DataFrame:
    """Add the tie-averaged rank of x in its group; NULL stays NULL.

    ``pct`` divides by the number of non-null values of the group.
    """
    return with_ranks(df, by, {out: x}, pct)


def _ranked_whole(rows: DataFrame, by: list[str], columns: dict[str, str], pct: bool) -> DataFrame:
    """``with_ranks`` of groups that a task can sort: rows move once, and no column makes rows of its own."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy()

    def rank(x: Column) -> Column:
        along = whole.orderBy(x.asc_nulls_last())
        first, upto = F.rank().over(along), F.count(F.lit(1)).over(along)
        place = first + (upto - first) / F.lit(2.0)
        return F.when(x.isNotNull(), place / F.count(x).over(whole) if pct else place)

    return rows.select("*", *[rank(F.col(x).cast("double")).alias(out) for out, x in columns.items()])


def with_ranks(
    df: DataFrame,
    by: Sequence[str],
    columns: dict[str, str],
    pct: bool = True,
) -> DataFrame:
    """``with_rank`` for many columns: output name -> input name."""
    by = list(by)
    # The input feeds the sizes, the ranges and the join back: compute it once, as a table.
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "ranked")
    sizes = rows.groupBy(*by).count() if by else rows.agg(F.count(F.lit(1)).alias("count"))
    if (sizes.agg(F.max("count")).first()[0] or 0) <= WHOLE_RANGES * RANGE_VALUES:
        return _ranked_whole(rows.drop("__row"), by, columns, pct)
    # All columns in one long pass: one ranking, one aggregate back to rows.
    cells = F.array(*[F.struct(F.lit(i).alias("__f"), F.col(x).cast("double").alias("__x")) for i, x in enumerate(columns.values())])
    long = rows.select("__row", *by, F.inline(cells)).filter("__x is not null")
    group = [*by, "__f"]
    ranged = ranged_values(long, group, "__x", "__row", F.lit(1))
    base = _before(ranged, group, F.lit(1)).alias("b")
    # A range of one value needs no sort, so its rows are dealt to many tasks.
    single = F.col("__part") % 2 == 1
    ranged = ranged.withColumn("__share", F.when(single, F.pmod(F.xxhash64("__row"), F.lit(RANGES))).otherwise(0))
    held = Window.partitionBy(*group, "__part", "__share").orderBy("__x")
    ranged = ranged.withColumns({"__rank": F.rank().over(held), "__upto": F.count(F.lit(1)).over(held)}).alias("v")
    n = F.when(F.col("v.__part") % 2 == 1, F.col("__held")).otherwise(F.col("__upto") - F.col("__rank") + 1)
    rank = F.col("__before") + F.when(F.col("v.__part") % 2 == 1, 1).otherwise(F.col("__rank")) + (n - 1) / F.lit(2.0)
    ranked = ranged.join(base, _equal([*group, "__part"], "v", "b")).select(
        "__row", F.col("v.__f").alias("__f"), (rank / F.col("total") if pct else rank).alias("__k")
    )
    wide = ranked.groupBy("__row").agg(
        *[F.max(F.when(F.col("__f") == i, F.col("__k"))).alias(out) for i, out in enumerate(columns)]
    )
    return rows.join(wide, "__row", "left").drop("__row")


def with_ordinal(df: DataFrame, by: Sequence[str], x: str, ties: Sequence[str], out: str) -> DataFrame:
    """Add a unique 1-based rank: by x, then by the ``ties`` columns.  NULL rows go.

    Rows are sorted per (group, bucket of x); a bucket is bounded only as far as
    equal x values are, so heavy ties are split further by a second level, ranges
    of the first tie column when it is numeric or a date.
    """
    by = list(by)
    df = df.filter(F.col(x).isNotNull())
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "date", "short")}
    lead = ties[0] if ties else None
    tie_value = None
    if lead in numeric:
        c = F.col(lead)
        is_date = dict(df.dtypes)[lead] == "date"
        tie_value = F.unix_date(c).cast("double") if is_date else c.cast("double")
    staged = df.withColumn("__bucket", order_bucket(F.col(x).cast("double")))
    # Second level: 64 consecutive days or keys together, only used inside equal x.
    second = F.floor(tie_value / 64).cast("long") if tie_value is not None else F.lit(0).cast("long")
    staged = staged.withColumn("__x", F.col(x)).withColumn("__second", second)
    keys = [*by, "__bucket"]
    inner = [*keys, "__x", "__second"]
    counts = staged.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n"))
    # Offsets inside a bucket, then of the buckets; both over counts only.
    in_bucket = Window.partitionBy(*keys).orderBy("__x", "__second").rowsBetween(Window.unboundedPreceding, -1)
    along = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__bucket")
    base = counts.groupBy(*keys).agg(F.sum("__n").alias("__bn")).select(
        *keys, F.coalesce(F.sum("__bn").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b0")
    )
    offsets = counts.withColumn("__i0", F.coalesce(F.sum("__n").over(in_bucket), F.lit(0))).join(base, keys)
    offsets = offsets.select(*inner, (F.col("__b0") + F.col("__i0")).alias("__before"))
    order = Window.partitionBy(*inner).orderBy(*ties) if ties else Window.partitionBy(*inner).orderBy(F.lit(1))
    ranked = staged.join(offsets, inner)
    return ranked.withColumn(out, F.col("__before") + F.row_number().over(order)).drop(
        "__bucket", "__x", "__second", "__before"
    )


def quantiles(df: DataFrame, by: Sequence[str], x: str, points: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group (one row per group)."""
    by = list(by)
    ranks = value_ranks(df, by, x)
    terms = []
    for name, q in points.items():
        place = F.lit(q) * (F.col("total") - 1)
        low = F.floor(place)
        high = F.ceil(place)
        inside = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        at_low = F.max(F.when(inside(low), F.col(x)))
        at_high = F.max(F.when(inside(high), F.col(x)))
        part = F.max(place - low)
        terms.append((at_low + (at_high - at_low) * part).alias(name))
    return ranks.groupBy(*by).agg(*terms) if by else ranks.agg(*terms)


def kth_smallest(df: DataFrame, by: Sequence[str], x: str, k: Column, out: str) -> DataFrame:
    """The k-th smallest value per group; ``k`` may use ``total``."""
    ranks = value_ranks(df, by, x)
    hit = (F.col("below") < k) & (k <= F.col("below") + F.col("n"))
    agg = F.max(F.when(hit, F.col(x))).alias(out), F.max("total").alias("n")
    return ranks.groupBy(*by).agg(*agg) if by else ranks.agg(*agg)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
