"""Exponentially weighted means as window sums.

``y_0 = x_0, y_t = (1-w) y_{t-1} + w x_t`` unrolls to a weighted sum, so inside
one anchor block it is a running ``sum`` window; the value at the end of the
previous block carries over with a known factor.  No Python, no joins: the
whole family shares the exchange of the other windows on the same axis.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import Axis


@dataclass(frozen=True)
class Ewm:
    """One exponential mean: input column, smoothing factor, warm-up, weighting."""

    source: str
    alpha: float
    min_periods: int = 0
    adjust: bool = False

    @staticmethod
    def span(source: str, span: float, min_periods: int = 0, adjust: bool = False) -> Ewm:
        return Ewm(source, 2.0 / (span + 1.0), min_periods, adjust)

    @staticmethod
    def wilder(source: str, period: int, min_periods: int = 0) -> Ewm:
        return Ewm(source, 1.0 / period, min_periods)


# Decay, in powers of e, that one block spans; older blocks than the one before weigh nothing.
SPAN = 200.0
# Decay of one step beyond which what came before is lost in a double.
LOST = 60.0


def with_ewm(df: DataFrame, ax: Axis, specs: dict[str, Ewm]) -> DataFrame:
    """Add one column per spec, with the weights of pandas' ``ewm(ignore_na=False)``.

    Leading NULLs are skipped; NULLs inside a series keep the last mean, and weights decay
    over them.  After a gap of g rows a mean without ``adjust`` moves by ``a / (a + (1-a)^g)``.

    The decay up to each row is a running sum, and a block is a stretch of equal decay.
    Block and time order the rows as time does, so one sort serves the sums inside blocks
    and the value carried over from the block before.
    """
    keep = df.columns
    direct = {out: s for out, s in specs.items() if s.alpha >= 1.0}
    work = {out: s for out, s in specs.items() if s.alpha < 1.0}
    sources = list({s.source: s for s in specs.values()})
    seen = {src: f"__seen_{i}" for i, src in enumerate(sources)}
    gap = {src: f"__gap_{i}" for i, src in enumerate(sources)}
    before = ax.ordered().rowsBetween(Window.unboundedPreceding, -1)
    staged = df.withColumn("__pos", ax.position())
    staged = staged.withColumns(
        {col: F.count(F.col(src)).over(ax.running()) for src, col in seen.items()}
        | {
            col: F.col("__pos") - F.last(F.when(F.col(src).isNotNull(), F.col("__pos")), ignorenulls=True).over(before)
            for src, col in gap.items()
        }
    )

    # Outputs of one smoothing factor, source and weighting share decay and blocks.
    kinds = {(s.source, s.alpha, s.adjust): f"__{i}" for i, s in enumerate(work.values())}
    for (source, alpha, adjust), k in kinds.items():
        x, rate = F.col(source), -math.log(1.0 - alpha)
        if adjust:
            staged = staged.withColumns({f"{k}w": F.lit(1.0), f"{k}d": F.col("__pos") * F.lit(rate)})
            continue
        first = F.col(seen[source]) == 1
        weight = alpha / (alpha + F.exp(-rate * F.col(gap[source])))
        step = F.least(-F.log1p(-weight), F.lit(LOST))
        staged = staged.withColumns(
            {
                f"{k}w": F.when(first, 1.0).otherwise(weight),
                f"{k}d": F.coalesce(F.sum(F.when(x.isNotNull() & ~first, step)).over(ax.running()), F.lit(0.0)),
            }
        )
    mean = {}
    for (source, _, adjust), k in kinds.items():
        x, decay = F.col(source), F.col(f"{k}d")
        staged = staged.withColumn(f"{k}b", F.floor(decay / SPAN))
        inside = Axis((*ax.keys, f"{k}b"), ax.time).running()
        grown = F.when(x.isNotNull(), F.col(f"{k}w") * F.exp(decay - F.col(f"{k}b") * SPAN))
        sums = {f"{k}n": F.sum(grown * x).over(inside)}
        if adjust:
            sums[f"{k}m"] = F.sum(grown).over(inside)
        staged = staged.withColumns({c: F.coalesce(v, F.lit(0.0)) for c, v in sums.items()})
        # Sums at the end of a block that has values, seen from later blocks.  The first pass brings
        # in the block before, the second carries the two together.
        along = Window.partitionBy(*ax.keys).orderBy(f"{k}b", ax.time)
        past = along.rowsBetween(Window.unboundedPreceding, -1)
        filled = F.count(x).over(inside) > 0
        staged = staged.withColumn(f"{k}end", (F.lead(f"{k}b").over(along) != F.col(f"{k}b")) & filled)
        for level in (1, 2):
            local = F.struct(F.col(f"{k}b").alias("b"), *(F.col(f"{c}{'w' if level == 2 else ''}").alias(c) for c in sums))
            staged = staged.withColumn(f"{k}kept", F.when(F.col(f"{k}end"), local))
            staged = staged.withColumn(f"{k}past", F.last(f"{k}kept", ignorenulls=True).over(past))
            fall = F.exp((F.col(f"{k}past.b") - F.col(f"{k}b")) * SPAN)
            staged = staged.withColumns(
                {f"{c}w": F.col(c) + F.coalesce(F.col(f"{k}past.{c}") * fall, F.lit(0.0)) for c in sums}
            )
        if adjust:
            old = F.try_divide(F.col(f"{k}past.{k}n"), F.col(f"{k}past.{k}m"))
            mean[k] = F.when(F.col(f"{k}m") == 0, old).otherwise(F.try_divide(F.col(f"{k}nw"), F.col(f"{k}mw")))
        else:
            mean[k] = F.col(f"{k}nw") * F.exp(F.col(f"{k}b") * SPAN - decay)
    final = {
        out: F.when(F.col(seen[s.source]) >= max(s.min_periods, 1), mean[kinds[(s.source, s.alpha, s.adjust)]])
        for out, s in work.items()
    }
    for out, s in direct.items():
        last = F.last(s.source, ignorenulls=True).over(ax.running())
        final[out] = F.when(F.col(seen[s.source]) >= max(s.min_periods, 1), last)
    return staged.withColumns(final).select(*keep, *specs)
