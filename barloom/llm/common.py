"""Shared pieces of the corpus operators: word rules, names, shipping of code to tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of characters other than these six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send the functions of a module to tasks by value, so executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


class Kept(dict):
    """key -> ``make(key)``, kept for the next time.

    Two generations of at most ``limit`` keys bound memory: when the younger one is full, the
    older one goes, except what is used again.  Long keys are made anew each time.
    """

    limit, longest = 500_000, 40

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def make(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        found = self.older.pop(key, None)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def per_worker(name: str, make: Callable):
    """What ``make`` gives, made once in a Python worker process and kept for its later tasks."""
    kept = sys.modules.setdefault("barloom_kept_in_worker", types.ModuleType("barloom_kept_in_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, even inside lambdas of ``use``.

    A lambda re-evaluates the expressions it mentions for every element; a lambda
    variable is evaluated once.
    """
    return F.transform(F.array(value), use)[0]


# Bits of a sieve: 1024 bitmaps of 4 kB, however many keys there are.
SIEVE_BITS = 2**25


def sieved(df: DataFrame, keys: DataFrame, *names: str, out: str = "__maybe") -> DataFrame:
    """Add ``out``: false only for rows whose values of the columns ``names`` are in no row of ``keys``.

    Each key sets one of ``SIEVE_BITS`` bits, so what is broadcast does not grow with the tables; with very many keys
    more rows pass by chance.  A join with ``keys`` still has to decide about rows that pass, but need not move the others.
    """
    slot = F.pmod(F.xxhash64(*names), F.lit(SIEVE_BITS)) + 1
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits")
    bits = keys.select(slot.alias("__slot")).groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(bitmap)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substr("__bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    joined = df.join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("__bucket"), "left")
    return joined.select(*df.columns, found.alias(out))


def partitions(df: DataFrame) -> int:
    """Partitions a shuffle of this session uses."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what an Arrow batch of whole texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
