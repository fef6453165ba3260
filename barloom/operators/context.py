"""Cross-section, market and sector context, peer correlation and clusters."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.expr import DAILY, EPS, Axis, clip, ratio
from barloom.functions.rolling import Roll, with_rolling
from barloom.operators import pair_blocks
from barloom.operators.pair_blocks import Blocks, place
from barloom.operators.ranking import with_ranks
from barloom.session import materialize, scratch_path
from barloom.sources import files

# Look-backs of the context features.
CONTEXT_HORIZONS = (5, 20, 60, 120, 252)
MACRO_HORIZONS = (20, 60, 120, 252)


def percentile_ranks(
    df: DataFrame, columns: Sequence[str], time: str = "date", suffix: str = "_rank"
) -> DataFrame:
    """Tie-averaged percentile rank per date of every column, in (0, 1]."""
    return with_ranks(df, [time], {f"{c}{suffix}": c for c in columns})


def equal_weight_index(df: DataFrame, by: Sequence[str] = (), ax: Axis = DAILY, out: str = "level") -> DataFrame:
    """Index level per date (and per ``by`` group) from the mean log return of members.

    The mean is a map-side aggregate; only one row per date reaches the window.
    """
    returns = df.select(*by, ax.time, ax.log_return(F.col("close")).alias("__r"))
    means = returns.groupBy(*by, ax.time).agg(F.avg("__r").alias("__m"))
    path = Axis(tuple(by), ax.time)
    level = F.when(F.col("__m").isNotNull(), F.exp(F.sum("__m").over(path.running())))
    return means.select(*by, ax.time, level.alias(out))


def with_sector(df: DataFrame, sectors: DataFrame, default: str = "MARKET", key: str = "ticker") -> DataFrame:
    """Attach the sector label; unknown tickers fall into ``default``."""
    labels = sectors.select(key, F.col("sector").cast("string").alias("sector"))
    return df.join(labels, key, "left").withColumn("sector", F.coalesce("sector", F.lit(default)))


def with_levels(df: DataFrame, ax: Axis = DAILY) -> DataFrame:
    """Market and sector index levels on every row (needs ``sector``)."""
    market = equal_weight_index(df, (), ax, "market_level")
    sector = equal_weight_index(df, ("sector",), ax, "sector_level")
    return df.join(market, ax.time, "left").join(sector, ["sector", ax.time], "left")


def relative_strength(df: DataFrame, ax: Axis = DAILY, horizons: Sequence[int] = CONTEXT_HORIZONS) -> DataFrame:
    """rs_sector, rs_market, sector_vs_market over the ticker's own rows."""
    cols = {}
    for h in horizons:
        own, sector, market = (ax.log_return(F.col(c), h) for c in ("close", "sector_level", "market_level"))
        cols[f"rs_sector{h}"] = own - sector
        cols[f"rs_market{h}"] = own - market
        cols[f"sector_vs_market{h}"] = sector - market
    return df.withColumns(cols)


def macro_features(df: DataFrame, ax: Axis = DAILY, horizons: Sequence[int] = MACRO_HORIZONS) -> DataFrame:
    """macro_trend and macro_vol of the market level over the ticker's own rows."""
    level = F.col("market_level")
    staged = df.withColumns(
        {"__md": ax.log_return(level)} | {f"macro_trend{h}": ax.log_return(level, h) for h in horizons}
    )
    return with_rolling(staged, ax, {f"macro_vol{h}": Roll("std", "__md", h) for h in horizons}).drop("__md")


def hierarchical_context(df: DataFrame, sectors: DataFrame, ax: Axis = DAILY) -> DataFrame:
    staged = with_levels(with_sector(df, sectors), ax)
    return macro_features(relative_strength(staged, ax), ax).drop("market_level", "sector_level")


def scale_macro(df: DataFrame, columns: Sequence[str], fit_until: str | None = None, time: str = "date") -> DataFrame:
    """0.5 + 0.15 z, z over time clipped at 3; fitted on rows before ``fit_until``."""
    fit = df if fit_until is None else df.filter(F.col(time) < F.lit(fit_until).cast("date"))
    stats = fit.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_samp(c).alias(f"{c}_s") for c in columns]
        ).alias("s")
    ).scalar()
    staged = df.withColumn("__s", stats)
    s = F.col("__s")
    z = {c: (F.col(c) - s[f"{c}_m"]) / (s[f"{c}_s"] + EPS) for c in columns}
    return staged.withColumns({c: 0.5 + 0.15 * clip(x, -3.0, 3.0) for c, x in z.items()}).drop("__s")


def residual_returns(df: DataFrame, ax: Axis = DAILY) -> DataFrame:
    """Log return less the date's mean return, as ``residual``."""
    staged = df.withColumn("__r", ax.log_return(F.col("close")))
    staged = staged.join(staged.groupBy(ax.time).agg(F.avg("__r").alias("__m")), ax.time)
    return staged.withColumn("residual", F.col("__r") - F.col("__m")).drop("__r", "__m")


# ---- pairwise correlation ----------------------------------------------------

TILE = pair_blocks.TILE  # tickers per tile edge while there are few tiles
BLOCK_A, BLOCK_B = 256, 512  # tickers multiplied at a time


# Tasks get these functions by value, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Series = list[tuple[np.ndarray, np.ndarray]]


def _dense(series: Series, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where missing) and presence, days by tickers."""
    z, w = np.zeros((len(days), len(series))), np.zeros((len(days), len(series)))
    for k, (day, x) in enumerate(series):
        at = np.searchsorted(days, day)
        z[at, k], w[at, k] = x, 1.0
    return z, w


def _correlations(left: Series, right: Series | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first of left, first of right, common dates, correlation) of a block of tickers against a block at a time.

    Without ``right`` left meets itself, in blocks that hold a pair of it in order.  A correlation that is not defined is NaN.
    """
    if not left or right == []:
        return
    same, right = right is None, left if right is None else right
    days = np.unique(np.concatenate([day for day, _ in (left if same else [*left, *right])]))
    for i in range(0, len(left), BLOCK_A):
        za, wa = _dense(left[i : i + BLOCK_A], days)
        for j in range(0, len(right), BLOCK_B):
            if same and min(j + BLOCK_B, len(right)) - 1 <= i:
                continue
            zb, wb = _dense(right[j : j + BLOCK_B], days)
            n, sa, sb = wa.T @ wb, za.T @ wb, wa.T @ zb
            count = np.maximum(n, 1.0)
            cov = za.T @ zb - sa * sb / count
            va = (za * za).T @ wb - sa * sa / count
            vb = wa.T @ (zb * zb) - sb * sb / count
            known = (n > 0) & (va > 1e-30) & (vb > 1e-30)
            yield i, j, n, np.where(known, cov / np.sqrt(np.where(known, va * vb, 1.0)), np.nan)


def _tile(path: str, tile: int) -> tuple[pa.Array | None, Series]:
    """The names and centred series of a tile, in order of name."""
    where, root = place(f"{path}/tile={tile}")
    found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
    parts = [pq.ParquetFile(where.open_input_file(f.path)).read() for f in found if f.base_name.endswith(".parquet")]
    if not parts:
        return None, []
    table = pa.concat_tables(parts).combine_chunks()
    table = table.take(pc.sort_indices(table.column("ticker")))
    series = []
    for mean, day, x in zip(table.column("mean").to_numpy(), table.column("day"), table.column("x")):
        x = x.values.to_numpy(zero_copy_only=False) - mean
        whole = ~np.isnan(x)
        series.append((day.values.to_numpy()[whole], x[whole]))
    return table.column("ticker").combine_chunks(), series


def _cells(spark: SparkSession, tiles: int, task: Callable[[int, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``task`` gives for every two tiles i <= j, a task of Spark for each."""
    cells = [(i, j) for i in range(tiles) for j in range(i, tiles)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from task(*cells[k])

    # Of rows of an RDD Spark takes no size for granted, so it never broadcasts the pairs.
    numbers = spark.sparkContext.parallelize([(k,) for k in range(len(cells))], max(1, len(cells)))
    return spark.createDataFrame(numbers, "k int").mapInArrow(each, schema)


def _series(df: DataFrame, x: str, key: str, time: str) -> DataFrame:
    """One row per ticker: its mean, dates and values."""
    # Rows without a date meet each other as one more date.
    day = F.coalesce(F.unix_date(time), F.lit(-(2**31)))
    values = df.filter(F.col(x).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("ticker"), day.alias("day"), F.col(x).cast("double").alias("x"))
    # Each ticker is centred, so the sums do not cancel.
    series = values.groupBy("ticker").agg(F.avg("x").alias("mean"), F.collect_list(F.struct("day", "x")).alias("s"))
    return series.select("ticker", "mean", F.col("s.day").alias("day"), F.col("s.x").alias("x"))


def _write_tiles(series: DataFrame, tiles: int) -> str:
    """Write series with their ``tile`` in a folder per tile."""
    path = scratch_path(series.sparkSession, "tiles")
    series.repartition(tiles, "tile").write.partitionBy("tile").parquet(path)
    return path


def pair_correlation(df: DataFrame, x: str, key: str = "ticker", time: str = "date") -> DataFrame:
    """Pearson correlation of every pair of tickers (a < b) over their common dates.

    A tiled matrix product: a ticker's dates and values are one row of arrays, tickers are hashed into
    tiles, and tiles are written as folders.  A task reads two tiles and gives out their finished pairs,
    block by block; neither sums of pairs nor pairs of rows nor copies of the series are shuffled.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    first = scratch_path(spark, "series")
    _series(df, x, key, time).write.parquet(first)
    series = spark.read.parquet(first)
    tiles = pair_blocks.tiles_of(series.count(), TILE)
    path = _write_tiles(series.withColumn("tile", F.pmod(F.xxhash64("ticker"), F.lit(tiles))), tiles)
    files.remove(first)

    def correlate(i: int, j: int) -> Iterator[pa.RecordBatch]:
        (left, one), (right, two) = _tile(path, i), (None, None) if i == j else _tile(path, j)
        if not one or two == []:
            return
        names = left if i == j else pa.concat_arrays([left, right])
        rank = np.empty(len(names), np.int64)
        rank[np.asarray(pc.sort_indices(names))] = np.arange(len(names))
        for p, q, n, rho in _correlations(one, two):
            keep = n > 0
            if i == j:
                keep &= (np.arange(p, p + n.shape[0])[:, None]) < np.arange(q, q + n.shape[1])[None, :]
            a, b = np.nonzero(keep)
            n, rho = n[a, b], rho[a, b]
            a, b = a + p, b + q + (0 if i == j else len(one))
            low, high = np.where(rank[a] < rank[b], (a, b), (b, a))
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(low)), names.take(pa.array(high)), pa.array(n.astype(np.int64)), pa.array(rho, mask=np.isnan(rho))],
                names=["a", "b", "n", "rho"],
            )

    return _cells(spark, tiles, correlate, f"a {kind}, b {kind}, n long, rho double")


def pair_distances(df: DataFrame, x: str, names: Sequence, key: str = "ticker", time: str = "date") -> Blocks:
    """max(0, 1 - correlation) - 1 of every pair of ``names`` with a common date, as blocks; a correlation that is not defined counts as 0.

    Blocks are written by the tasks that find them, one of two tiles and its mirror image.
    """
    spark, kind, n = df.sparkSession, dict(df.dtypes)[key], len(names)
    tiles = pair_blocks.tiles_of(n, TILE)
    blocks = Blocks(scratch_path(spark, "pair-distance"), n, max(1, -(-n // tiles)))
    index = spark.createDataFrame(list(zip(names, range(n))), f"ticker {kind}, rank int")
    series = _series(df, x, key, time).join(index, "ticker")
    path = _write_tiles(series.withColumn("tile", F.floor(F.col("rank") / blocks.edge)), tiles)
    order = pa.array(names)

    def place_of(found: pa.Array, tile: int) -> np.ndarray:
        return pc.index_in(found.cast(order.type), order.slice(tile * blocks.edge, blocks.edge)).to_numpy(zero_copy_only=False).astype(np.int64)

    def write(i: int, j: int) -> Iterator[pa.RecordBatch]:
        block = np.full((blocks.width(i), blocks.width(j)), np.nan)
        (left, one), (right, two) = _tile(path, i), (None, None) if i == j else _tile(path, j)
        if one and two != []:
            ia = place_of(left, i)
            ib = ia if i == j else place_of(right, j)
            for p, q, n, rho in _correlations(one, two):
                value = np.where(n > 0, np.maximum(0.0, 1.0 - np.where(np.isnan(rho), 0.0, rho)) - 1.0, np.nan)
                block[np.ix_(ia[p : p + n.shape[0]], ib[q : q + n.shape[1]])] = value
        if i == j:
            block = np.triu(np.where(np.isnan(block), block.T, block), 1)
            block = block + block.T
            np.fill_diagonal(block, np.nan)
        else:
            blocks.write(j, i, block.T)
        blocks.write(i, j, block)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32())], names=["i"])

    _cells(spark, blocks.tiles, write, "i int").collect()
    files.remove(path)
    return blocks


def column_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns (a before b), one aggregate pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(str(i)).alias("rho"))
                      for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(names).alias("p")).select("p.a", "p.b", "p.rho")


# ---- clusters ------------------------------------------------------------------


def _distances(corr: DataFrame) -> DataFrame:
    """max(0, 1 - rho) of every pair, a < b; a missing correlation counts as 0."""
    d = F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.col("rho"), F.lit(0.0)))
    return corr.select("a", "b", d.alias("dist"))


def _both_ways(dist: DataFrame) -> DataFrame:
    """Every pair in both directions; its rows are read once."""
    ends = (F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "dist") for x, y in ("ab", "ba"))
    return dist.select(F.inline(F.array(*ends)))


def pair_distance(corr: DataFrame) -> DataFrame:
    """Both directions of max(0, 1 - rho); a missing correlation counts as 0."""
    return _both_ways(_distances(corr))


def silhouettes(dist: DataFrame | Blocks, clusters: DataFrame, names: Sequence = ()) -> DataFrame:
    """(k, silhouette): the mean silhouette of each clustering (k, a, cluster) on pair distances.

    Mean distances to clusters are taken for all clusterings side by side.  Of a table, the clusters are written, so
    that Spark sees how small they are and leaves the pairs where they lie.  Blocks (``pair_distances`` of
    ``names``) are multiplied by the clusterings, tile by tile.
    """
    if isinstance(dist, Blocks):
        labels: dict[int, dict] = {}
        for k, a, cluster in zip(*clusters.select("k", "a", "cluster").toArrow().to_pydict().values()):
            labels.setdefault(k, {})[a] = cluster
        ks = sorted(labels)
        numbers = [np.unique([labels[k][a] for a in names], return_inverse=True)[1] for k in ks]
        found = pair_blocks.silhouette_sums(clusters.sparkSession, dist, numbers, 1.0)
        rows = [(k, s / n) for k, (s, n) in zip(ks, found) if n]
        return clusters.sparkSession.createDataFrame(rows, "k int, silhouette double")
    clusters = materialize(clusters.select("k", "a", "cluster"), "clusters")
    own = clusters.select("k", "a", F.col("cluster").alias("own"))
    other = clusters.select("k", F.col("a").alias("b"), F.col("cluster").alias("other"))
    pairs = dist.join(own, "a").join(other, ["b", "k"])
    mean = pairs.groupBy("k", "a", "own", "other").agg(F.avg("dist").alias("m"))
    sides = mean.groupBy("k", "a").agg(
        F.min(F.when(F.col("own") == F.col("other"), F.col("m"))).alias("inside"),
        F.min(F.when(F.col("own") != F.col("other"), F.col("m"))).alias("outside"),
    )
    top = F.greatest("inside", "outside")
    score = F.when(F.col("inside").isNull() | F.col("outside").isNull(), 0.0).otherwise(
        F.coalesce(ratio(F.col("outside") - F.col("inside"), top), F.lit(0.0))
    )
    return sides.groupBy("k").agg(F.avg(score).alias("silhouette"))


def silhouette(dist: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean silhouette of one clustering (a, cluster) on a pair-distance table."""
    one = silhouettes(dist, clusters.withColumn("k", F.lit(0))).select("silhouette")
    return one.agg(F.max("silhouette").alias("silhouette"))


def _as_blocks(dist: DataFrame, names: Sequence, missing: float) -> Blocks:
    """The pairs of a table (a < b) as blocks of their distances less ``missing``."""
    spark, kind, n = dist.sparkSession, dict(dist.dtypes)["a"], len(names)
    tiles = pair_blocks.tiles_of(n, TILE)
    blocks = Blocks(scratch_path(spark, "pair-distance"), n, max(1, -(-n // tiles)))
    index = spark.createDataFrame(list(zip(names, range(n))), f"name {kind}, rank int")
    placed = dist.select("a", "b", (F.col("dist") - missing).alias("s"))
    for end in "ab":
        placed = placed.join(index.toDF(end, f"r{end}"), end)
    ways = [F.struct(F.col(f"r{x}").alias("x"), F.col(f"r{y}").alias("y"), "s") for x, y in ("ab", "ba")]
    cell = F.floor(F.col("x") / blocks.edge) * blocks.tiles + F.floor(F.col("y") / blocks.edge)
    both = placed.select(F.inline(F.array(*ways))).withColumn("cell", cell)
    both = both.repartition(max(1, blocks.tiles**2), "cell").sortWithinPartitions("cell")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            x, y, s, cells = (batch.column(c).to_numpy() for c in range(4))
            for k in np.unique(cells):
                i, j = divmod(int(k), blocks.tiles)
                if k != last:
                    if last is not None:
                        blocks.write(*divmod(int(last), blocks.tiles), block)
                    last, block = k, np.full((blocks.width(i), blocks.width(j)), np.nan)
                of = cells == k
                block[x[of] - i * blocks.edge, y[of] - j * blocks.edge] = s[of]
        if last is not None:
            blocks.write(*divmod(int(last), blocks.tiles), block)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["i"])

    both.mapInArrow(write, "i int").collect()
    return blocks


def average_linkage(dist: DataFrame | Blocks, missing: float = 1.0, names: Sequence = ()) -> DataFrame:
    """The merges of average-linkage clustering of pair distances: a table (a, b, dist), of which a < b is read, or blocks.

    Columns: ``step`` (from 1, by height), ``a`` and ``b`` (the smallest members of the two clusters, a < b),
    ``height``.  Clusters that are each other's nearest merge in one round, all of them at once: with
    average linkage a merge never brings a third cluster nearer than it was, so these are the merges that
    taking the nearest pair one by one makes.  Ties go to the smaller pair.  Distances lie in files as blocks
    (``pair_blocks.Linkage``); the driver keeps a few numbers per name.  A pair that the table lacks counts
    as ``missing``; clusters without any pair never merge.  Heights are compared to 12 digits.  Blocks come
    with their ``names``, in order.
    """
    if isinstance(dist, Blocks):
        spark, blocks = SparkSession.active(), dist
        kind = spark.createDataFrame([(names[0],)], ["a"]).dtypes[0][1] if len(names) else "string"
    else:
        spark, kind = dist.sparkSession, dict(dist.dtypes)["a"]
        rows = dist.filter("a < b and dist is not null")
        names = [r[0] for r in rows.select(F.explode(F.array("a", "b")).alias("n")).distinct().orderBy("n").collect()]
        blocks = _as_blocks(rows, names, missing)
    low, high, height = pair_blocks.Linkage(spark, blocks, missing).run()
    if not isinstance(dist, Blocks):
        files.remove(blocks.path)
    # Heights of average linkage never fall, so height order is merge order.
    rows = [(k, names[a], names[b], h) for k, (a, b, h) in enumerate(zip(low.tolist(), high.tolist(), height.tolist()), 1)]
    return spark.createDataFrame(rows, f"step long, a {kind}, b {kind}, height double")


def _names(names: DataFrame, limit: int = 100_000) -> list:
    """The names of a frame of one column in order, at most ``limit``."""
    every = [r[0] for r in names.orderBy(names.columns[0]).limit(limit + 1).collect()]
    if len(every) > limit:
        raise ValueError(f"more than {limit} names to cluster")
    return every


def cut_tree(merges: DataFrame, names: DataFrame, counts: Sequence[int], limit: int = 100_000) -> DataFrame:
    """(k, a, cluster) for every number of clusters in ``counts``: the cluster's smallest name.

    ``names`` has one column, the clustered names.  The tree has one row per name, fewer than the
    pair distances by as many; it is walked on the driver, for at most ``limit`` names.
    """
    every = _names(names, limit)
    root = {n: n for n in every}

    def top(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    steps = [(r["a"], r["b"]) for r in merges.orderBy("step").collect()]
    rows, done = [], 0
    for k in sorted(set(counts), reverse=True):
        while done < min(len(steps), len(every) - k):
            a, b = sorted(map(top, steps[done]))
            root[b] = a
            done += 1
        rows += [(k, n, top(n)) for n in every]
    kind = dict(names.dtypes)[names.columns[0]]
    return names.sparkSession.createDataFrame(rows, f"k int, a {kind}, cluster {kind}")


def correlation_clusters(
    df: DataFrame,
    universe: DataFrame,
    n_clusters: int | None = None,
    insample_end: str | None = None,
    k_range: tuple[int, int] = (8, 20),
    min_obs: int = 250,
    market_neutral: bool = True,
    ax: Axis = DAILY,
) -> DataFrame:
    """ticker -> cluster label ``CLnn`` from return co-movement, by average linkage.

    ``universe`` (one column of tickers) bounds what is clustered: there is a distance for every pair of it.
    The number of clusters is the one with the best mean silhouette, of equal ones the smallest.  Labels are numbered by
    the smallest ticker of the cluster.  Tickers of ``df`` outside the universe, with little history, or of
    a universe that has too few to be cut, are ``MARKET``.  Only data up to ``insample_end`` are used.
    """
    key = ax.keys[0]
    sample = df if insample_end is None else df.filter(F.col(ax.time) <= F.lit(insample_end).cast("date"))
    sample = sample.join(universe.select(F.col(universe.columns[0]).alias(key)).distinct(), key, "left_semi")
    returns = sample.select(key, ax.time, ax.log_return(F.col("close")).alias("r")).filter("r is not null")
    valid = returns.groupBy(key).count().filter(F.col("count") >= min_obs).select(F.col(key).alias("a"))
    valid = materialize(valid, "clustered")
    everyone = df.select(key).distinct()
    n = valid.count()
    if n < k_range[0] + 1:
        return everyone.withColumn("cluster", F.lit("MARKET"))
    used = returns.join(valid.withColumnRenamed("a", key), key, "left_semi")
    if market_neutral:
        mean = used.groupBy(ax.time).agg(F.avg("r").alias("__m"))
        used = used.join(mean, ax.time).withColumn("r", F.col("r") - F.col("__m"))
    names = _names(valid)
    blocks = pair_distances(used, "r", names, key, ax.time)
    ks = [n_clusters] if n_clusters else list(range(k_range[0], min(k_range[1], n - 1) + 1))
    labels = cut_tree(average_linkage(blocks, names=names), valid, ks)
    if n_clusters is None:
        best = silhouettes(blocks, labels, names).orderBy(F.desc(F.round("silhouette", 12)), "k").first()["k"]
        labels = labels.filter(F.col("k") == best)
    files.remove(blocks.path)
    number = F.dense_rank().over(Window.orderBy("cluster")) - 1
    named = labels.select(F.col("a").alias(key), F.format_string("CL%02d", number).alias("cluster"))
    return everyone.join(named, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit("MARKET")))


# ---- column groups ----------------------------------------------------------

# Column-name prefixes and the layer they belong to.
LAYERS = (
    ("macro_", "macro regime"),
    ("sector_vs_market", "sector vs market"),
    ("rs_sector", "stock vs sector"),
    ("rs_market", "stock vs market"),
    ("sent_rank", "sentiment"),
)


def layer_of(column: Column) -> Column:
    """The context layer a feature name belongs to."""
    out = None
    for prefix, layer in LAYERS:
        test = column.startswith(prefix)
        out = F.when(test, layer) if out is None else out.when(test, layer)
    return out.otherwise("stock own")


def macro_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith("macro_")]
