"""Registered queries: joins of timestamped tables, streams, and the compacted store."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import bands as D
from barloom.operators import timejoins as J
from barloom.plans.q_metrics import scored_choices
from barloom.plans.q_sources import STORE_SQL, VEC_SQL, store_rows, vector_columns
from barloom.plans.registry import ORACLES, query
from barloom.plans.sqltext import INTRADAY
from barloom.session import scratch_path
from barloom.sources.datasets import table
from barloom.sources.store import FeatureStore, LedgerTable
from barloom.streaming import bars as B
from barloom.streaming.ledger import feed


# ---- as-of and interval joins -----------------------------------------------------

def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "t12_asof_join",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'),
 r AS (SELECT user_id, ts, max(event_id) AS p_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
 SELECT l.event_id, l.user_id, CASE WHEN l.ts - r.ts <= INTERVAL 2 DAY THEN r.p_id END AS last_purchase,
  CASE WHEN l.ts - r.ts <= INTERVAL 2 DAY THEN epoch_us(l.ts) - epoch_us(r.ts) END AS age
 FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof(spark, sf_dir):
    """Every other event with its user's last purchase, at most two days old."""
    events = _events(spark, sf_dir)
    rest = events.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    out = J.asof_join(rest, bought, ["user_id"], "ts", tolerance=2 * 86_400)
    age = F.unix_micros("ts") - F.unix_micros("asof_ts")
    return out.select("event_id", "user_id", F.col("asof_event_id").alias("last_purchase"), age.alias("age"))


@query(
    "t12_asof_join_market",
    """SELECT l.event_id, r.event_id AS last_error FROM events l ASOF LEFT JOIN
 (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1) r ON l.ts >= r.ts""",
)
def asof_one_key(spark, sf_dir):
    """One key for all rows: the last error anywhere before each event."""
    one = _events(spark, sf_dir).withColumn("all", F.lit(1))
    errors = one.filter("event_type = 'error'").select("all", "ts", "event_id")
    out = J.asof_join(one.select("event_id", "ts", "all"), errors, ["all"], "ts")
    return out.select("event_id", F.col("asof_event_id").alias("last_error"))


_SPANS = """w AS (SELECT event_id AS w_id, user_id, ts AS t0, ts + to_microseconds(CAST(round(value * 600000000) AS BIGINT)) AS t1
  FROM events WHERE event_type = 'signup' AND value > 0)"""


def _spans(spark, sf_dir):
    """A window behind every signup, minutes to days long by its value."""
    rows = _events(spark, sf_dir).filter("event_type = 'signup' and value > 0")
    length = F.round(F.col("value") * 600_000_000).cast("long")
    return rows.select(
        F.col("event_id").alias("w_id"), "user_id", F.col("ts").alias("t0"), F.timestamp_micros(F.unix_micros("ts") + length).alias("t1")
    )


@query(
    "v03_interval_join",
    f"WITH {_SPANS} SELECT w_id, event_id FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= t0 AND e.ts < t1",
)
def interval(spark, sf_dir):
    """Events of a user inside the windows of the same user."""
    points = _events(spark, sf_dir).select("user_id", "event_id", "ts")
    return J.overlap_join(_spans(spark, sf_dir), points, ["user_id"], ("t0", "t1"), ("ts", "ts")).select("w_id", "event_id")


@query(
    "v07_overlapping_windows",
    f"""WITH {_SPANS} SELECT a.w_id AS a_id, b.w_id AS b_id FROM w a JOIN w b
 ON a.user_id = b.user_id AND a.w_id < b.w_id AND a.t0 < b.t1 AND b.t0 < a.t1""",
)
def overlapping(spark, sf_dir):
    """Pairs of windows of a user that overlap, each once."""
    a, b = (_spans(spark, sf_dir).toDF(f"{s}_id", "user_id", f"{s}0", f"{s}1") for s in "ab")
    met = J.overlap_join(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"))
    return met.filter("a_id < b_id").select("a_id", "b_id")


# ---- streams ----------------------------------------------------------------------


@query(
    "s05_stream_bars",
    f"""WITH {INTRADAY}, m AS (SELECT max(ts) AS t FROM events WHERE value > 0)
 SELECT ticker, ts, round(close, 6) AS close, high, low, volume FROM bars, m WHERE ts + INTERVAL 1 HOUR <= t - INTERVAL 2 HOUR""",
)
def stream_bars(spark, sf_dir):
    """Events arrive in three lots; each run of the stream takes up the one before.  The bars that the watermark closed."""
    events = _events(spark, sf_dir).select("ts", "event_type", "value")
    inbox, bars, checkpoint = (scratch_path(spark, f"stream-{k}") for k in ("ticks", "bars", "state"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * k / 3 for k in (1, 2)]
    lot = sum(((F.col("ts") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for k in range(3):
        events.filter(lot == k).write.mode("append").parquet(inbox)
        stream = B.file_stream(spark, inbox, events.schema)
        B.write_available(B.windowed_bars(stream), bars, checkpoint)
    return spark.read.parquet(bars).select("ticker", "ts", F.round("close", 6).alias("close"), "high", "low", "volume")


@query("d03_stream_ledger", ORACLES["d03_ledger_append"])
def stream_ledger(spark, sf_dir):
    """Choices arrive, then repeats of them and changed ones: repeats add nothing, changes win."""
    rows = scored_choices(spark, sf_dir)
    inbox, checkpoint = scratch_path(spark, "choices"), scratch_path(spark, "choices-state")
    ledger = LedgerTable(spark, scratch_path(spark, "ledger"))
    again = rows.filter("horizon <> '5d'").withColumn("signal", F.lit("hold"))
    schema = D.as_ledger(rows).schema
    for lot in (rows, again.unionByName(rows.filter("horizon = '5d'"))):
        D.as_ledger(lot).write.mode("append").parquet(inbox)
        feed(B.file_stream(spark, inbox, schema), ledger, checkpoint)
    return ledger.read().select("ticker", "date", "horizon", "source", "signal", F.round("pct_error", 6).alias("pct_error"))


# ---- compacted store ----------------------------------------------------------------


@query("s14_store_compaction", f"{STORE_SQL} {VEC_SQL}")
def compacted(spark, sf_dir):
    """Batches per half-decade and a correcting one, merged into one batch; the replaced files are removed."""
    store = FeatureStore(spark, scratch_path(spark, "store"))
    one, five = store_rows(spark, sf_dir, 1, 5)
    store.upsert(one, ["a", "b"], "label", 1)
    for low, high in (("1900-01-01", "1996-01-01"), ("1996-01-01", "2100-01-01")):
        part = five.filter((F.col("date") >= low) & (F.col("date") < high))
        store.upsert(part, ["a", "b"], "label", 5)
    store.upsert(five.withColumn("a", -F.col("a")), ["a", "b"], "label", 5)
    store.compact()
    store.vacuum()
    return vector_columns(store.current())
