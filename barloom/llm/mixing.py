"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, served once or more.  A document's
virtual finish time is the running size of its source up to its end, divided by the
source's target, so all sources reach time 1 together when each has given its
target.  Documents of all sources are ordered by finish time and cut at the total budget.

Both running sums are two-level: totals of hash (or time) ranges are added up first,
then rows inside a range.  A source with a third of all rows is spread over its ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, partitions
from barloom.session import materialize

ROWS_PER_RANGE = 100_000
SEED = 11


def cycle(*weights: float) -> Callable[[Column], Column]:
    """Weights that repeat along the order of the sources."""
    return lambda position: F.get(F.array(*map(F.lit, weights)), (position % len(weights)).cast("int")).cast("double")


def positions(table: DataFrame, key: str, out: str) -> DataFrame:
    """Number the rows of ``table`` from 0 in order of ``key`` (code points, null last).

    Range partitions are numbered apart and shifted by what the ranges before them hold.
    """
    order = F.asc_nulls_last(key)
    ranged = materialize(
        table.repartitionByRange(partitions(table), order).withColumn("__range", F.spark_partition_id()), "mixing-order"
    )
    shifts = (
        ranged.groupBy("__range")
        .count()
        .select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    return ranged.join(shifts, "__range").withColumn(out, F.col("__before") + inside).drop("__range", "__before")


def targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """Add ``target`` to (source_size, weight): ``share`` of all sizes dealt by weight.

    A source stops at ``repeats`` times its size; what is left over is dealt again by
    weight among the others, until none is above.  Without any words all targets are 0.
    """
    cap = repeats * F.col("source_size")
    budget = share * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = cap <= level * F.col("weight")
        got = sources.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if got[0] == full or not got[2]:
            break
        full, level = got[0], (budget - float(got[1] or 0)) / got[2]
    if not got[2]:  # every source is at its limit
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))


def _ranges(rows: int) -> int:
    return max(16, -(-rows // ROWS_PER_RANGE))


def schedule(
    df: DataFrame,
    weigh: Callable[[Column], Column],
    share: float = 1.5,
    repeats: int = 2,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``df``: id, source, draw, size, source_size, target, copies.

    ``weigh`` gives a source's weight from its position among the sources, ordered by
    code point with null last.  ``size`` counts words (null texts: 0), ``copies`` says how
    often the mix takes the document, 0 to ``repeats``.  Documents without words are
    never taken.  The order inside a source follows a hash of seed, id and text, so
    reruns agree; equal rows may swap places.  An empty table gives none.
    """
    sized = materialize(
        df.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"),
        ),
        "mixing-sizes",
    )
    ranges = _ranges(sized.count())
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = positions(totals, "source", "position").withColumn("weight", weigh(F.col("position")))
    sources = materialize(targets(sources, share, repeats), "mixing-targets")

    # Running size inside each source, along the shuffled order.
    rows = sized.join(sources.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    slot = F.floor((F.col("draw") / 2.0**63 + 1) / 2 * ranges)
    rows = materialize(rows.withColumn("__slot", slot), "mixing-rows")
    along = Window.partitionBy("position").orderBy("__slot")
    shifts = (
        rows.groupBy("position", "__slot")
        .agg(F.sum("size").alias("__sum"))
        .select("position", "__slot", (F.sum("__sum").over(along) - F.col("__sum")).alias("__before"))
    )
    inside = Window.partitionBy("position", "__slot").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = materialize(
        rows.join(shifts, ["position", "__slot"])
        .withColumn("__end", F.col("__before") + F.sum("size").over(inside))
        .drop("__before", "__slot", "weight"),
        "mixing-queued",
    )
    last = _cut(queued, repeats, ranges)

    def taken(turn: int) -> Column:
        if last is None:
            return F.lit(0)
        at = F.struct(_finish(turn), F.col("position"))
        return ((F.col("size") > 0) & (at <= F.struct(F.lit(last[0]), F.lit(last[1]).cast("long")))).cast("int")

    copies = sum((taken(turn) for turn in range(1, repeats)), taken(0))
    return queued.select("id", "source", "draw", "size", "source_size", "target", copies.alias("copies"))


def _finish(turn: int) -> Column:
    """Virtual finish time of a document in a turn of its source."""
    return (turn * F.col("source_size") + F.col("__end")) / F.col("target")


def _cut(queued: DataFrame, repeats: int, ranges: int) -> tuple[float, int] | None:
    """(finish time, source position) of the last document within the total budget, or None.

    Finish times are spread evenly, so ranges of equal width hold about equal
    numbers; only the range in which the budget ends is sorted.
    """
    budget = queued.select("position", "target").distinct().agg(F.sum("target")).first()[0]
    turns = F.array(*(_finish(turn) for turn in range(repeats)))
    served = queued.filter("size > 0 and target > 0").select("position", "size", F.explode(turns).alias("at"))
    served = served.withColumn("__range", F.floor(F.col("at") * ranges))
    sums = served.groupBy("__range").agg(F.sum("size").alias("__sum"), F.max("at").alias("__top"))
    upto = F.sum("__sum").over(Window.orderBy("__range"))
    crossed = sums.withColumn("__upto", upto).filter(F.col("__upto") > (budget or 0.0)).orderBy("__range").first()
    if crossed is None:  # the budget takes everything
        end = served.agg(F.max(F.struct("at", "position")).alias("end")).first()["end"]
        return tuple(end) if end else None
    before = crossed["__upto"] - crossed["__sum"]
    running = F.sum("size").over(Window.orderBy("at", "position").rowsBetween(Window.unboundedPreceding, 0))
    inside = (
        served.filter(F.col("__range") == crossed["__range"])
        .withColumn("__running", running)
        .filter(F.col("__running") + before <= budget)
    )
    end = inside.agg(F.max(F.struct("at", "position")).alias("end")).first()["end"]
    if end is None:
        low = served.filter(F.col("__range") < crossed["__range"])
        end = low.agg(F.max(F.struct("at", "position")).alias("end")).first()["end"]
    return tuple(end) if end else None


def mix(df: DataFrame, weigh: Callable[[Column], Column], **options) -> DataFrame:
    """The mixed corpus: the rows of ``df``, all columns, each as often as the schedule takes it."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    plan = schedule(df, weigh, **options).filter("copies > 0")
    # Rows of one draw are equal and so interchangeable: the first ones get the odd copies.
    dealt = plan.groupBy("draw").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    draw = F.xxhash64(F.lit(options.get("seed", SEED)), F.col(id_col), F.col(text_col))
    joined = df.withColumn("__draw", draw).join(dealt.withColumnRenamed("draw", "__draw"), "__draw")
    turn = F.row_number().over(Window.partitionBy("__draw").orderBy("__draw"))
    odd = (turn <= F.col("__copies") % F.col("__rows")).cast("long")
    copies = F.floor(F.col("__copies") / F.col("__rows")) + odd
    return joined.withColumn("__n", copies).withColumn(
        "__n", F.explode(F.array_repeat(F.lit(1), F.col("__n").cast("int")))
    ).select(*df.columns)
