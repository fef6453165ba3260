"""SimHash near-duplicates found with pivot distance tables.

Fingerprints are 64-bit majority votes over the hashes of word shingles.  Links
join fingerprints that differ in at most ``radius`` bits.  The work in order:

1. Equal fingerprints collapse to one row first, so exact copies cost nothing later.
2. Fingerprints meet in units: of ``BLOCKS`` blocks of bits at least
   ``BLOCKS - radius`` must agree, so each fingerprint is filed under every pair of
   blocks (an equi-join, no cross join).  A unit above ``unit_rows`` rows is cut into
   chunk pairs that run as tasks of their own.
3. Inside a unit each fingerprint has a row of Hamming distances to the pivots.
   Distances obey the triangle inequality, so a pair whose rows differ by more than
   ``radius`` in any coordinate is discarded; survivors are verified by their bits.
   A walk over not yet reached members reports a spanning forest of the links,
   never all pairs of a dense group.
4. Components come from rounds of minima over links (see ``components``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions, ship
from barloom.llm.components import components
from barloom.session import materialize

ship(__name__)

SEED = 42
BLOCKS = 6
# Members of a unit up to which pairs are compared by shifting the sorted arrays.
SHIFTED = 24


def hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, repeats included; fewer words give one shingle."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: 1 - width].tolist() if width > 1 else starts.tolist(), ends[width - 1 :].tolist())
    return np.array([digest(joined[i:j], SEED) for i, j in spans], dtype=np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the shingle hashes."""
    return majority(hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): one fingerprint per row of ``df``; null or wordless texts have fingerprint 0."""
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_type}, fp long")


def pivot_set(n: int, seed: int) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random words of 64 bits."""
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every pivot, one row per fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def _shifted(unit: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of small units: row i against row i + 1, i + 2, ... while both are in one unit."""
    out = []
    for step in range(1, len(unit)):
        i = np.nonzero(unit[step:] == unit[:-step])[0]
        if not len(i):
            break
        i = i[np.abs(table[i] - table[i + step]).max(axis=1) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= radius]
        out.append((fps[i], fps[i + step]))
    return out


def _walked(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links of one unit.

    Members are sorted by distance to the first pivot, so a member meets only the slice
    of not yet reached ones within ``radius``; the other pivots thin the slice out.
    """
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left, out, queue, start = np.arange(len(fps)), [], [], 0
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = table[left, 0]
        lo, hi = np.searchsorted(near, [table[at, 0] - radius, table[at, 0] + radius + 1])
        some = np.arange(lo, hi)
        for p in range(1, table.shape[1]):
            if not len(some):
                break
            some = some[np.abs(table[left[some], p] - table[at, p]) <= radius]
        some = some[np.bitwise_count(fps[left[some]] ^ fps[at]) <= radius]
        if len(some):
            reached = left[some]
            out.append((np.full(len(reached), fps[at]), fps[reached]))
            queue.extend(reached.tolist())
            left = np.delete(left, some)
    return out


def unit_links(unit: np.ndarray, fps: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole units; ``unit`` is sorted.  Connects what is connected in each unit."""
    bounds = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
    sizes = np.diff(bounds)
    size_of = np.repeat(sizes, sizes)
    small = (size_of > 1) & (size_of <= SHIFTED)
    links = _shifted(unit[small], fps[small], pivot_table(fps[small], pivots), radius)
    for at in np.flatnonzero(sizes > SHIFTED):
        own = np.unique(fps[bounds[at] : bounds[at + 1]])
        links += _walked(own, pivot_table(own, pivots), radius)
    if not links:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])


def cells(rows: DataFrame, unit_rows: int) -> DataFrame:
    """(fp, unit): the units of ``rows``; one above ``unit_rows`` rows becomes all pairs of its chunks."""
    large = rows.groupBy("unit").agg(F.ceil(F.count("*") / unit_rows).alias("chunks")).filter("chunks > 1")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    dealt = F.when(
        F.col("chunks") > 1,
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
            lambda other: F.xxhash64(F.col("unit"), F.least(chunk, other), F.greatest(chunk, other)),
        ),
    ).otherwise(F.array("unit"))
    return rows.join(large, "unit", "left").select("fp", F.explode(dealt).alias("unit"))


def _filed(distinct: DataFrame, radius: int, unit_rows: int) -> DataFrame:
    """(unit, fp): every fingerprint under each choice of blocks that a link must leave equal."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be 0 to {BLOCKS - 1}")
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]

    def block(i: int):
        mask = (1 << (edges[i + 1] - edges[i])) - 1
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit(mask))

    filed = [
        F.xxhash64(F.lit(n), *(block(i) for i in held))
        for n, held in enumerate(combinations(range(BLOCKS), BLOCKS - radius))
    ]
    return cells(distinct.select("fp", F.explode(F.array(*filed)).alias("unit")), unit_rows)


def links(distinct: DataFrame, radius: int = 4, pivots: int = 16, seed: int = 7, unit_rows: int = 20_000) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``distinct`` (column ``fp``) within ``radius`` bits.

    Two fingerprints within the radius are always connected by the rows returned,
    directly or through others; dense groups give a spanning forest, not all pairs.
    """
    reference = pivot_set(pivots, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            ends = [pa.array(x.astype(np.uint64).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            unit = np.concatenate([unit, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            done = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            if done:  # the last unit may go on in the next batch
                yield found(*unit_links(unit[:done], fps[:done], reference, radius))
                unit, fps = unit[done:], fps[done:]
        if len(unit):
            yield found(*unit_links(unit, fps, reference, radius))

    filed = _filed(distinct, radius, unit_rows).select("unit", "fp")
    dealt = filed.repartition(partitions(distinct), "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    radius: int = 4,
    pivots: int = 16,
) -> DataFrame:
    """(id_col, fp, component_id) for every row of ``df``.

    component_id is the smallest id reachable over links, the row's own id included.
    Null, empty and wordless texts have fingerprint 0 and link like any other.  Rows
    without an id take part, but are never the smallest; a group of only such rows
    has component_id null.  Repeated rows are repeated in the result, an empty table
    gives none, further columns of ``df`` are ignored.
    """
    prints = materialize(fingerprints(df, id_col, text_col, width), "simhash-fp")
    groups = prints.groupBy("fp").agg(F.min("id").alias("first"))
    reach = components(links(groups.select("fp"), radius, pivots), "a", "b")
    linked = reach.join(groups, reach.node == groups.fp).select("node", "root", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    named = linked.join(lowest, "root").select(F.col("node").alias("fp"), "lowest")
    labels = groups.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 4) -> DataFrame:
    """The rows of ``df``, all columns, with one row for each near-duplicate group: the smallest id.

    Rows without an id stay.  Rows that repeat the kept id come once.
    """
    groups = near_duplicates(df, id_col, text_col, width, radius)
    kept = groups.filter(F.col(id_col) == F.col("component_id")).select(id_col)
    named = df.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(*df.columns)
    return named.unionByName(df.filter(F.col(id_col).isNull()))
