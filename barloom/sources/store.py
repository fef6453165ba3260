"""Feature store and ledger on Parquet, as logs of batches.

The feature store writes every upsert as a batch of its own and then commits it by one small
manifest, which tells the batch's order and, per horizon, its range of dates.  What the
manifests name is the store; files of a batch that was never committed are not seen.  Readers
list the manifests once and so see one state, open only batches whose dates they ask for,
and keep the newest row per key.  Compaction merges batches into one and commits it by a manifest
that replaces theirs, in one move.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.operators.bands import LEDGER_KEY, as_ledger, dedupe_last
from barloom.sources import files

KEY = ("date", "ticker", "horizon")
ROW = "date date, ticker string, vec array<double>, label tinyint, horizon smallint, batch string"


def _batch_id() -> str:
    """Orders batches by the time they were begun; the tail tells writers of one moment apart."""
    return f"t{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


@dataclass(frozen=True)
class Batch:
    """A committed batch: its folder, the first and last date and rows per horizon, the batches it stands for, and
    whether each key is in it once."""

    name: str
    spans: dict[int, tuple[str, str, int]]
    replaces: tuple[str, ...] = ()
    unique: bool = False


class FeatureStore:
    """(date, ticker, horizon) -> feature vector and label."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # -- log -----------------------------------------------------------------

    def batches(self) -> list[Batch]:
        """The batches that make up the store now, in order."""
        folder = f"{self.path}/manifests"
        found = []
        for name in files.names(folder):
            if name.endswith(".json"):
                told = json.loads(files.read(f"{folder}/{name}"))
                spans = {int(h): tuple(s) for h, s in told["spans"].items()}
                found.append(Batch(told["name"], spans, tuple(told["replaces"]), told.get("unique", False)))
        gone = {old for b in found for old in b.replaces}
        return [b for b in found if b.name not in gone]

    def _write(self, rows: DataFrame, replaces: Sequence[str] = (), name: str | None = None) -> None:
        """Write ``rows`` as a batch and commit it; sorted by date in files of one horizon and month, one row per key.

        All rows of a key meet in the task that writes their month, so keeping one of them needs no
        further shuffle.  Rows of a new batch get its name there.
        """
        fresh, name = "batch" not in rows.columns, name or _batch_id()
        at = f"{self.path}/data/commit={name}"
        dealt = rows.withColumn("month", F.trunc("date", "month")).repartition("horizon", "month")
        one = Window.partitionBy("horizon", "month", "date", "ticker").orderBy("vec", "label")
        dealt = dealt.withColumn("__rn", F.row_number().over(one)).filter("__rn = 1").drop("__rn")
        dealt = dealt.sortWithinPartitions("horizon", "month", "date")
        if fresh:
            dealt = dealt.withColumn("batch", F.lit(name))
        dealt.write.mode("errorifexists").partitionBy("horizon", "month").parquet(at)
        spans = {}
        if any(n.startswith("horizon=") for n in files.names(at)):
            written = self.spark.read.parquet(at).groupBy("horizon")
            told = written.agg(F.min("date").alias("low"), F.max("date").alias("high"), F.count(F.lit(1)).alias("n")).collect()
            spans = {r["horizon"]: [str(r["low"]), str(r["high"]), r["n"]] for r in told}
        text = json.dumps({"name": name, "spans": spans, "replaces": list(replaces), "unique": True})
        files.write(f"{self.path}/manifests/{name}.json", text)

    def _newest(self, horizon: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The newest row per key; a horizon that lies in one batch of unique keys is read as it is."""
        live = self.batches()
        if not live:
            raise FileNotFoundError(f"empty feature store: {self.path}")
        levels = {h for b in live for h in b.spans} if horizon is None else {horizon}
        held = {h: [b for b in live if h in b.spans] for h in levels}
        plain = {h for h, found in held.items() if len(found) == 1 and found[0].unique}
        parts = []
        if plain:
            parts.append(self._read(live, plain, start, end))
        if levels - plain or not plain:
            parts.append(dedupe_last(self._read(live, levels - plain, start, end), "batch", KEY))
        return reduce(DataFrame.unionByName, parts)

    def _read(self, live: Sequence[Batch], horizons: set[int], start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows of the batches that can hold rows of the horizons and of start <= date < end, every version."""
        wanted = lambda low, high: (start is None or high >= start) and (end is None or low < end)
        paths = [
            f"{self.path}/data/commit={b.name}/horizon={h}"
            for b in live
            for h, (low, high, _) in b.spans.items()
            if h in horizons and wanted(low, high)
        ]
        if not paths:
            return self.spark.createDataFrame([], ROW)
        out = self.spark.read.option("basePath", f"{self.path}/data").schema(f"{ROW}, month date, commit string").parquet(*paths)
        for bound, keep in ((start, F.col("date") >= F.lit(start)), (end, F.col("date") < F.lit(end))):
            out = out if bound is None else out.filter(keep)
        # The same bounds on the folders, which are months.
        if start is not None:
            out = out.filter(F.col("month") >= F.trunc(F.lit(start).cast("date"), "month"))
        if end is not None:
            out = out.filter(F.col("month") < F.lit(end).cast("date"))
        return out.drop("month", "commit")

    # -- rows ----------------------------------------------------------------

    def upsert(self, df: DataFrame, features: Sequence[str], label: str, horizon: int | None = None) -> None:
        """Insert or replace; ``horizon`` may be a column already."""
        level, name = F.col("horizon") if horizon is None else F.lit(horizon), _batch_id()
        rows = df.select(
            F.col("date").cast("date").alias("date"),
            F.col("ticker").cast("string").alias("ticker"),
            F.array(*[F.col(f).cast("double") for f in features]).alias("vec"),
            F.col(label).cast("byte").alias("label"),
            level.cast("short").alias("horizon"),
        )
        self._write(rows, name=name)

    def compact(self, least: int = 2) -> bool:
        """Merge all batches into one that keeps the newest row per key; False if there are fewer than ``least``.

        Rows keep the batch they came from, so an upsert begun before the compaction and
        committed after it still wins or loses by its own order.  Readers see the old
        batches until the one manifest is there, and the merged one after it.
        """
        live = self.batches()
        if len(live) < least:
            return False
        self._write(self._newest(), [b.name for b in live])
        return True

    def vacuum(self) -> int:
        """Remove the files and manifests of batches that a compaction replaced; run it when no reader uses them."""
        live = {b.name for b in self.batches()}
        gone = [n for n in (m.removesuffix(".json") for m in files.names(f"{self.path}/manifests") if m.endswith(".json")) if n not in live]
        for name in gone:
            files.remove(f"{self.path}/data/commit={name}")
            files.remove(f"{self.path}/manifests/{name}.json")
        return len(gone)

    def current(self) -> DataFrame:
        return self._newest().drop("batch")

    def load_range(
        self, horizon: int, start: str | None = None, end: str | None = None, label_only: bool = True
    ) -> DataFrame:
        """Rows of one horizon with start <= date < end (ISO dates).

        Only batches and months that overlap the range are opened.
        """
        out = self._newest(horizon, start, end).drop("batch")
        return out.filter("label is not null") if label_only else out

    def load_all(self, horizon: int) -> DataFrame:
        return self.load_range(horizon)

    def summary(self) -> DataFrame:
        """horizon, rows, first and last date of the labelled rows."""
        return (
            self.current()
            .filter("label is not null")
            .groupBy("horizon")
            .agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        )

    def horizons(self) -> DataFrame:
        """The horizons stored, ascending; none for an empty store.  Manifests tell them, no rows are read."""
        found = sorted({h for b in self.batches() for h in b.spans})
        return self.spark.createDataFrame([(h,) for h in found], "horizon int")


class LedgerTable:
    """The decision ledger on disk; later appends win on the key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        """Add rows as a batch.  Writing a named ``batch`` again replaces it, so a repeated append changes nothing."""
        as_ledger(rows).write.mode("overwrite").parquet(f"{self.path.rstrip('/')}/batch={batch or _batch_id()}")

    def read(self) -> DataFrame:
        return dedupe_last(self.spark.read.parquet(self.path), "batch", LEDGER_KEY).drop("batch")


def write_results(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Result sink: csv (with header), parquet or json."""
    writer = df.write.mode("errorifexists")
    {"csv": lambda: writer.option("header", "true").csv(path), "parquet": lambda: writer.parquet(path),
     "json": lambda: writer.json(path)}[kind]()


def merge_scales(*results: DataFrame) -> DataFrame:
    """Result tables (label, days, mean_vol, auc) of several scales, by horizon in days."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.orderBy("days")
