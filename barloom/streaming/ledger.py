"""The decision ledger fed by a stream of scored choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.bands import LEDGER_COLUMNS
from barloom.sources import files
from barloom.sources.store import LedgerTable, _batch_id


def feed(choices: DataFrame, ledger: LedgerTable, checkpoint: str, arrived: str = "arrived", within: str = "2 days") -> None:
    """Append what has arrived since the last run, a batch of the ledger per micro-batch.

    Of equal rows that arrive within ``within`` of each other the first stays; a changed row is no
    repeat, and the later one wins in the ledger.  A micro-batch that is run again after a
    failure writes its batch anew in place of the old one.  Batches of the stream are ordered by when the stream
    was first started, then by number.
    """
    mark = f"{checkpoint.rstrip('/')}-origin"
    if not files.exists(mark):
        files.write(mark, _batch_id())
    origin = files.read(mark)
    cols = [F.col(c) if c in choices.columns else F.lit(None) for c in LEDGER_COLUMNS]
    rows = choices.select(F.col(arrived).alias("__at"), *(c.cast(k).alias(n) for c, (n, k) in zip(cols, LEDGER_COLUMNS.items())))
    once = rows.withWatermark("__at", within).dropDuplicatesWithinWatermark(list(LEDGER_COLUMNS))

    def append(batch: DataFrame, number: int) -> None:
        ledger.append(batch.drop("__at"), f"{origin}-{number:012d}")

    writer = once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
