"""Bootstrap of rank metrics: all replicates go along in arrays, rows are never multiplied.

Rows are sorted once per score, in ranges of it.  A range gives three arrays over the
replicates (positive weight, negative weight, and the pairs ordered rightly inside the range);
ranges add up to the statistic of each replicate by the negative weight below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.ranking import RANGES, ranged_values

PRIME = 2**31 - 1
# Hexadecimal digits of a digest that a draw uses.
DIGITS = 12
# Rows whose weights are held at once: this times the replicates, as doubles.
CHUNK_ROWS = 512


def poisson_steps() -> list[float]:
    """Distribution function of Poisson(1) at 0, 1, ...; beyond 18 the steps are below what a double can tell."""
    steps, total, term = [], 0.0, 0.36787944117144233
    for k in range(18):
        total += term
        steps.append(total)
        term /= k + 1
    return steps


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw from a uniform number."""
    out = F.when(u < 0, 0)
    for k, step in enumerate(poisson_steps()):
        out = out.when(u < step, k)
    return out.otherwise(18)


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def _row_number(keys: Sequence[str]) -> Column:
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") % PRIME


def _range_sums(rows: DataFrame, score: str, n_boot: int, seed: int) -> DataFrame:
    """(part, pos, neg, u) per range of the score, and per share of a range of one value."""
    factors = np.array([_number(f"{seed}:{r}:a") % (PRIME - 1) + 1 for r in range(n_boot)], dtype=np.int64)
    offsets = np.array([_number(f"{seed}:{r}:b") % PRIME for r in range(n_boot)], dtype=np.int64)
    steps, chunk, prime = np.array(poisson_steps()), CHUNK_ROWS, PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = None  # (part, share) of the range being read
        last = None  # its latest score, whose row sums wait in ``tie`` for more rows of that score
        zero = lambda: np.zeros(n_boot)
        pos, neg, u, tie = zero(), zero(), zero(), (zero(), zero())

        def shut() -> None:
            nonlocal pos, neg, u, tie
            p, n = tie
            u, pos, neg, tie = u + p * (neg + n / 2), pos + p, neg + n, (zero(), zero())

        def told() -> pa.RecordBatch:
            lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (pos, neg, u)]
            return pa.RecordBatch.from_arrays([pa.array([home[0]], pa.int64()), *lists], names=["part", "pos", "neg", "u"])

        for batch in batches:
            part, share, h, y, s = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(share) != 0)) + 1
            for lo, hi in zip([0, *new], [*new, len(part)]):
                if hi > lo and home != (part[lo], share[lo]):
                    if home is not None:
                        shut()
                        yield told()
                    home, last = (int(part[lo]), int(share[lo])), None
                    pos, neg, u, tie = zero(), zero(), zero(), (zero(), zero())
                for at in range(lo, hi, chunk):
                    end = min(at + chunk, hi)
                    draws = (h[at:end, None] * factors + offsets) % prime
                    w = np.searchsorted(steps, draws / float(prime), side="right").astype(float)
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(s[at:end])) + 1])
                    ps = np.add.reduceat(w * y[at:end, None], starts)
                    ns = np.add.reduceat(w, starts) - ps
                    if last is not None and last == s[at]:
                        ps[0] += tie[0]
                        ns[0] += tie[1]
                    elif last is not None:
                        shut()
                    # The last score may go on in the next chunk; those before it are whole.
                    below = neg + np.cumsum(ns, axis=0) - ns
                    u = u + (ps[:-1] * (below[:-1] + ns[:-1] / 2)).sum(axis=0)
                    pos, neg = pos + ps[:-1].sum(axis=0), neg + ns[:-1].sum(axis=0)
                    tie, last = (ps[-1], ns[-1]), s[end - 1]
        if home is not None:
            shut()
            yield told()

    ranged = ranged_values(rows.withColumnRenamed(score, "__s"), [], "__s", "h", F.lit(1))
    # A range of one value needs no order, so its rows are dealt to many tasks.
    share = F.when(F.col("__part") % 2 == 1, F.pmod(F.xxhash64("h"), F.lit(RANGES))).otherwise(0).cast("long")
    dealt = ranged.select(F.col("__part").cast("long").alias("part"), share.alias("share"), "h", "y", F.col("__s").alias("s"))
    sorted_ = dealt.repartition("part", "share").sortWithinPartitions("part", "share", "s")
    return sorted_.mapInArrow(run, "part long, pos array<double>, neg array<double>, u array<double>")


def replicate_auc(rows: DataFrame, score: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(rep, auc) of ``rows`` (h, y and the score): NULL where a replicate has one class only."""
    cell = F.posexplode(F.arrays_zip("pos", "neg", "u")).alias("rep", "c")
    sums = (
        _range_sums(rows, score, n_boot, seed)
        .select("part", cell)
        .groupBy("rep", "part")
        .agg(F.sum("c.pos").alias("pos"), F.sum("c.neg").alias("neg"), F.sum("c.u").alias("u"))
    )
    below = F.sum("neg").over(Window.partitionBy("rep").orderBy("part")) - F.col("neg")
    inside = F.when(F.col("part") % 2 == 1, F.col("pos") * F.col("neg") / 2).otherwise(F.col("u"))
    return (
        sums.select("rep", "pos", "neg", (inside + F.col("pos") * below).alias("u"))
        .groupBy("rep")
        .agg(ratio(F.sum("u"), F.sum("pos") * F.sum("neg")).alias("auc"))
    )


def bootstrap_auc_gap(
    df: DataFrame, y: str, a: str, b: str, keys: Sequence[str], n_boot: int = 1000, seed: int = 0
) -> DataFrame:
    """AUC gap of two scores: observed, 95 % interval, two-sided p.

    Resampling weights are Poisson(1) per (row, replicate): the digest of the key, mapped
    by a linear function of each replicate modulo a prime.  So both scores see the same draw and
    nothing depends on partitioning.  A one-class replicate counts as 0.  Rows with a null
    in y or a score are left out; rows of one key share their weights.
    """
    from barloom.operators.metrics import roc_auc

    rows = df.select(
        _row_number(keys).alias("h"), F.col(y).cast("double").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")
    ).dropna()
    one = replicate_auc(rows.select("h", "y", "a"), "a", n_boot, seed).withColumnRenamed("auc", "auc_a")
    two = replicate_auc(rows.select("h", "y", "b"), "b", n_boot, seed).withColumnRenamed("auc", "auc_b")
    gaps = one.join(two, "rep").select(F.coalesce(F.col("auc_a") - F.col("auc_b"), F.lit(0.0)).alias("gap"))
    seen = roc_auc(rows, "y", "a", out="v").scalar() - roc_auc(rows, "y", "b", out="v").scalar()
    tail = 2 * F.least(F.avg((F.col("gap") <= 0).cast("double")), F.avg((F.col("gap") >= 0).cast("double")))
    # One row per replicate: n_boot values, so an exact percentile aggregate is bounded.
    return gaps.agg(
        F.percentile("gap", F.lit(0.025)).alias("lo"),
        F.percentile("gap", F.lit(0.975)).alias("hi"),
        F.least(tail, F.lit(1.0)).alias("p_value"),
    ).select(seen.alias("gap"), "lo", "hi", "p_value")
