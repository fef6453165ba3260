"""Window helpers and null-safe arithmetic.

``Axis`` names the columns that make up one ordered series.  A daily panel is
unique on (ticker, date), so one series holds at most one row per calendar day
(36 525 rows in a century) whatever share of the raw input a ticker has; plain
windows by ticker are bounded there.  Timestamped panels have no such bound:
``operators.blocks`` adds a block key to the axis for those.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-9
TRADING_DAYS = 252


@dataclass(frozen=True)
class Axis:
    """The key columns and the order column of a series."""

    keys: tuple[str, ...] = ("ticker",)
    time: str = "date"

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def trailing(self, n: int) -> WindowSpec:
        return self.ordered().rowsBetween(-(n - 1), 0)

    def leading(self, n: int) -> WindowSpec:
        return self.ordered().rowsBetween(1, n)

    def running(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.ordered())

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.ordered())

    def full(self, agg: Callable[[Column], Column], x: Column, n: int, least: int | None = None) -> Column:
        """Trailing aggregate that stays NULL until ``least`` (default n) values are seen."""
        w = self.trailing(n)
        return F.when(F.count(x).over(w) >= (least or n), agg(x).over(w))

    def diff(self, x: Column, n: int = 1) -> Column:
        return x - self.lag(x, n)

    def log_return(self, price: Column, n: int = 1) -> Column:
        return F.log(price) - self.lag(F.log(price), n)

    def position(self) -> Column:
        """1-based row number inside the series."""
        return F.row_number().over(self.ordered())


DAILY = Axis()


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def null_if_zero(x: Column) -> Column:
    return F.when(x != 0, x)


def clip(x: Column, lo: Column | float | None = None, hi: Column | float | None = None) -> Column:
    """Clip that leaves NULL alone (greatest/least alone would skip it)."""
    out = x
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNotNull(), out)


def no_nan(x: Column) -> Column:
    """NaN and infinities become NULL, the only missing marker used here."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def gain(delta: Column) -> Column:
    return clip(delta, lo=0.0)


def loss(delta: Column) -> Column:
    return clip(-delta, lo=0.0)


def cut(x: Column, edges: tuple[float, ...]) -> Column:
    """0-based bucket of right-closed intervals split at ``edges``."""
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        out = out.when(x <= edge, i)
    return out.otherwise(len(edges))


def ewm_block(alpha: float) -> int:
    """Rows per anchor block for an exponential mean.

    A block must be long enough for anything older than the previous block to
    vanish in double precision, and short enough for the growing weights
    ``(1-alpha)^-k`` to stay finite.  Powers of eight keep several spans on the
    same block length, so they share one window.
    """
    rate = -math.log1p(-alpha)
    block = 128
    while block * rate < 45.0:
        block *= 8
    if block * rate > 650.0:
        block = int(650.0 / rate)
    return max(block, 1)


def ewm_memory(alpha: float) -> int:
    """Rows after which an input no longer changes a double-precision result."""
    return math.ceil(45.0 / -math.log1p(-alpha))
