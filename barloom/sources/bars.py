"""Bar files in and out, universe assembly, symbol and wide/long conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.expr import DAILY, Axis
from barloom.operators.bands import dedupe_last
from barloom.operators.cleaning import forward_fill

# Required columns, and the file names of one ticker in order of preference.
REQUIRED = ("open", "high", "low", "close", "volume")
FILE_SUFFIXES = (".us.txt", ".us.csv", ".csv")
FILE_GLOB = "*.{[cC][sS][vV],[tT][xX][tT]}"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case trimmed names, one name for the adjusted close; missing columns raise."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    out = out.withColumnsRenamed({"adj close": "adj_close", "adjclose": "adj_close"})
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return out


def coerce_dates(df: DataFrame, seq: str, key: str = "ticker") -> DataFrame:
    """Dates parsed, one row per (ticker, date): the one with the highest ``seq``."""
    dated = df.withColumn("date", F.to_date("date"))
    return dedupe_last(dated, seq, (key, "date")).drop(seq)


def _file(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _symbol(path: Column) -> Column:
    """Ticker from a ``ticker=`` folder, or else from the file name."""
    folder = F.regexp_extract(path, r"/ticker=([^/]+)/", 1)
    stem = F.upper(F.regexp_extract(_file(path), r"^(.*?)(\.us)?\.(csv|txt)$", 1))
    return F.when(folder != "", folder).otherwise(stem)


def _preference(path: Column) -> Column:
    """Rank of the file-name style, lower is better; NULL for other files."""
    name, out = _file(path), None
    for i, suffix in enumerate(FILE_SUFFIXES):
        out = F.when(name.endswith(suffix), i) if out is None else out.when(name.endswith(suffix), i)
    return out


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(ticker, path, preference) of the bar files below ``root``; contents are not read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", FILE_GLOB)
        .load(root)
        .select("path")
    )
    path = F.col("path")
    return listing.select(_symbol(path).alias("ticker"), "path", _preference(path).alias("preference"))


def list_available(spark: SparkSession, root: str) -> DataFrame:
    return list_files(spark, root).select("ticker").distinct().orderBy("ticker")


def _plain(names: Column) -> Column:
    """Header fields as plain names: trimmed, lower-case, one name for the adjusted close."""
    lower = F.transform(names, lambda n: F.lower(F.trim(F.regexp_replace(n, '["\\uFEFF]', ""))))
    return F.transform(lower, lambda n: F.when(n.isin("adj close", "adjclose"), "adj_close").otherwise(n))


def _fields(line: Column) -> Column:
    """The fields of a CSV line; commas inside quotes do not split."""
    parts = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda f: F.trim(F.regexp_replace(F.regexp_replace(F.trim(f), '^"|"$', ""), '""', '"')))


def read_bars(spark: SparkSession, root: str, universe: DataFrame | None = None) -> DataFrame:
    """All bar files as one long panel, one row per (ticker, date).

    Each file is read by its own header line, so files may order and name their columns
    differently; a file without a required column raises.  A ticker with several files
    uses the preferred name style, and a universe is a semi-join, so unknown tickers are
    skipped.  The headers are one small row per file, joined to the lines.
    """
    path = F.col("_metadata.file_path")
    order = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", FILE_GLOB)
        .text(root)
        .select("value", path.alias("__path"), order.alias("__seq"))
        .filter(F.trim("value") != "")
    )
    # A header is a file's first line that names the date; data lines name nothing.
    is_header = F.array_contains(_plain(_fields(F.col("value"))), "date")
    headers = lines.filter(is_header).groupBy("__path").agg(F.min_by("value", "__seq").alias("__header"))
    headers = headers.withColumn("__names", _plain(_fields(F.col("__header"))))
    files = list_files(spark, root).select(F.col("path").alias("__file"))
    faults = (
        files.join(headers, F.regexp_replace("__file", "^file:/+", "/") == F.regexp_replace("__path", "^file:/+", "/"), "left")
        .select("__file", F.array_except(F.array(*map(F.lit, REQUIRED)), F.coalesce("__names", F.array())).alias("lacks"))
        .filter(F.size("lacks") > 0)
        .first()
    )
    if faults:
        raise ValueError(f"missing required columns: {faults['lacks']} in {faults['__file']}")
    # The distinct names over all files: a handful.
    found = headers.select(F.explode("__names").alias("n")).distinct().collect()
    names = sorted({r["n"] for r in found} - {"ticker", ""} - set(REQUIRED) - {"date"})
    wanted = ["date", *REQUIRED, *names]

    best = list_files(spark, root).groupBy("ticker").agg(F.min("preference").alias("__best"))
    staged = lines.withColumns({"__symbol": _symbol(F.col("__path")), "__rank": _preference(F.col("__path"))})
    hit = (F.col("__symbol") == F.col("ticker")) & (F.col("__rank") <= F.col("__best"))
    staged = staged.join(best, hit, "left_semi").join(headers, "__path").filter(F.col("value") != F.col("__header"))
    staged = staged.withColumn("__f", _fields(F.col("value")))

    def field(name: str) -> Column:
        at = F.array_position("__names", name)
        got = F.when(at > 0, F.get("__f", (at - 1).cast("int")))
        got = F.when(got != "", got)
        return got.try_cast("double") if name in (*REQUIRED, "adj_close") else got

    typed = staged.select(F.col("__symbol").alias("ticker"), "__seq", *(field(c).alias(c) for c in wanted))
    bars = coerce_dates(typed, "__seq")
    return bars if universe is None else bars.join(universe, "ticker", "left_semi")


def read_ticker(spark: SparkSession, root: str, ticker: str) -> DataFrame:
    """One ticker's bars; raises when it has no file."""
    found = list_files(spark, root).filter(F.upper("ticker") == ticker.strip().upper())
    if found.isEmpty():
        raise FileNotFoundError(f"no bar file for {ticker} below {root}")
    return read_bars(spark, root, found.select("ticker"))


def write_bars(df: DataFrame, root: str) -> None:
    """CSV with a header, one folder per ticker."""
    df.write.option("header", "true").partitionBy("ticker").csv(root)


def to_long(df: DataFrame, value: str, time: str = "date") -> DataFrame:
    """A wide frame (one column per ticker) as (date, ticker, value)."""
    return df.unpivot([time], [c for c in df.columns if c != time], "ticker", value)


def to_wide(df: DataFrame, value: str, tickers: Sequence, time: str = "date") -> DataFrame:
    return df.groupBy(time).pivot("ticker", list(tickers)).agg(F.first(value))


def write_cache(df: DataFrame, path: str) -> None:
    """Long Parquet, sorted inside files by ticker and date so that statistics prune."""
    df.repartition("ticker").sortWithinPartitions("ticker", "date").write.parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_missing(cached: DataFrame, fetched: DataFrame, value: str = "close", fill: float | None = None, ax: Axis = DAILY):
    """Add only the tickers the cache lacks, on the cache's calendar, forward filled."""
    new = fetched.join(cached.select(*ax.keys).distinct(), list(ax.keys), "left_anti")
    days = cached.agg(F.array_sort(F.collect_set(ax.time))).scalar()
    grid = new.select(*ax.keys).distinct().select(*ax.keys, F.explode(days).alias(ax.time))
    placed = grid.join(new.select(*ax.keys, ax.time, value), [*ax.keys, ax.time], "left")
    filled = forward_fill(placed, [value], None, ax)
    if fill is not None:
        filled = filled.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
    return cached.select(*ax.keys, ax.time, value).unionByName(filled)


def with_fallback(primary: DataFrame, secondary: DataFrame, min_rows: int = 200, key: str = "ticker") -> DataFrame:
    """Tickers the primary source lacks, from the secondary one, when it has more than ``min_rows`` rows."""
    extra = secondary.join(primary.select(key).distinct(), key, "left_anti")
    enough = extra.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > min_rows)
    return primary.unionByName(extra.join(enough, key, "left_semi"))


def normalize_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.withColumn(column, F.translate(F.trim(F.col(column)), ".", "-"))
