"""Near-duplicates by the Jaccard similarity of their sets of word shingles.

A radius of 64-bit fingerprints cannot state a similarity of 0.8: such pairs differ in
about 10 bits and up to 20.  The work in order:

1. Texts of equal shingle sets collapse to one row first, and a task names the bands of a set once, so copies cost little later.
2. SimHash fingerprints of the texts are linked at ``RADIUS`` bits or fewer by the pivot tables of
   ``simhash.links``; texts of one fingerprint component are candidates of each other.
3. Beyond that radius candidates come from min-hashes in ``BANDS`` bands of ``WIDTH``: a pair of similarity s has an equal band with
   probability 1 - (1 - s^WIDTH)^BANDS, at s = 0.8 all but 5 in a million pairs.  Texts that
   meet in a band or a fingerprint component, directly or through others, form a candidate group.
4. A group is walked in one task, which holds its shingle sets; large groups are cut
   into chunk pairs.  Links are verified by exact set sizes, and a spanning forest of them is
   reported, never all pairs of a dense group.
5. Components come from rounds of minima over the verified links (see ``components``).

Texts and bands are by far the largest rows.  Before a join that most of them cannot meet, or whose outcome is
already certain for them, ``sieved`` sets them aside, so only the others are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import simhash
from barloom.llm.common import partitions, ship, sieved, small_batches
from barloom.llm.components import components
from barloom.llm.simhash import cells, hashes, majority
from barloom.session import materialize

ship(__name__)

BANDS, WIDTH = 52, 7
RADIUS = 4
# Sets that a task remembers to have named the bands of.
SEEN = 500_000
_draw = np.random.default_rng(11)
# Odd factors and offsets of the hash functions, and factors that join the min-hashes of a band.
FACTORS = _draw.integers(0, 2**32, BANDS * WIDTH, dtype=np.uint32) | np.uint32(1)
OFFSETS = _draw.integers(0, 2**32, BANDS * WIDTH, dtype=np.uint32)
JOINTS = _draw.integers(0, 2**64, (BANDS, WIDTH), dtype=np.uint64) | np.uint64(1)
STARTS = _draw.integers(0, 2**64, BANDS, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; wordless texts have none."""
    return np.unique(hashes(text, width))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band; an empty set has keys of its own."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * WIDTH, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 128):
        np.minimum(low, (x[at : at + 128, None] * FACTORS + OFFSETS).min(axis=0), out=low)
    return ((low.reshape(BANDS, WIDTH) * JOINTS).sum(axis=1, dtype=np.uint64) + STARTS).view(np.int64)


def _walked(ids: np.ndarray, sets: list[np.ndarray], similarity: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets: each reached one meets the not yet reached of fitting size."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    ids, sizes, sets = ids[order], sizes[order], [sets[i] for i in order]
    # Dense numbers of the shingles, so that a mark per shingle gives the sizes of intersections.
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    own = [flat[edges[i] : edges[i + 1]] for i in range(len(sets))]
    up, down = similarity.numerator, similarity.denominator
    marks = np.zeros(len(kinds) + 1, dtype=bool)
    left, out, queue = np.arange(len(sets)), [], []
    rest, at_rest, ends = left, flat, edges  # the sets, shingles and bounds of the rows not yet compacted away
    open_ = np.ones(len(sets), dtype=bool)
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            open_[left[0]], left = False, left[1:]
        if 2 * len(left) < len(rest):
            rest = left
            at_rest = np.concatenate([own[i] for i in rest]) if len(rest) else flat[:0]
            ends = np.concatenate([[0], np.cumsum(sizes[rest])])
        at = queue.pop()
        n = int(sizes[at])
        if not n:
            continue  # equal sets have collapsed, and an empty one is like no other
        lo = int(np.searchsorted(sizes[rest], -(-n * up // down)))
        hi = int(np.searchsorted(sizes[rest], n * down // up, side="right"))
        if lo >= hi:
            continue
        marks[own[at]] = True
        common = np.add.reduceat(marks[at_rest[ends[lo] : ends[hi]]].astype(np.int64), ends[lo:hi] - ends[lo])
        marks[own[at]] = False
        near = rest[lo:hi][(common * down >= up * (n + sizes[rest[lo:hi]] - common))]
        near = near[open_[near]]
        if len(near):
            out += [(ids[at], ids[i]) for i in near]
            queue.extend(near.tolist())
            open_[near] = False
            left = left[open_[left]]
    return out


def _rows(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, key, fp, mark, bands): hash of the text, hash of its shingle set, SimHash fingerprint, band keys.

    Further rows of a set in the same task have no bands.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fps, marks, bands = [], [], []
            for text in batch.column(2):
                found = hashes(text.as_py(), width)
                own = np.unique(found)
                fp = xxhash.xxh64_intdigest(own.tobytes())
                fps.append(fp)
                marks.append(majority(found))
                bands.append([] if fp in seen else band_keys(own))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
            fp = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            columns = [fp, pa.array(marks, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "key", "fp", "mark", "bands"])

    some = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return some.mapInArrow(run, f"id {id_type}, key long, fp long, mark long, bands array<long>")


def _links(members: DataFrame, parts: int, width: int, similarity: Fraction) -> DataFrame:
    """(a, b): verified links inside the units of ``members`` (unit, fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, fps, sets = None, [], []

        def found() -> pa.RecordBatch:
            one, at = np.unique(np.array(fps, dtype=np.int64), return_index=True)
            ends = _walked(one, [sets[i] for i in at], similarity) if len(one) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

        for batch in batches:
            for u, fp, text in zip(*(c.to_pylist() for c in batch.columns)):
                if u != unit and fps:
                    yield found()
                    fps, sets = [], []
                unit = u
                fps.append(fp)
                sets.append(shingle_set(text, width))
        if fps:
            yield found()

    dealt = members.select("unit", "fp", "text").repartition(parts, "unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(run, "a long, b long")


def _marked(sets: DataFrame) -> DataFrame:
    """(fp, band): sets of one component of fingerprints, linked by pivot tables, have one key."""
    near = components(simhash.links(sets.select(F.col("mark").alias("fp")).distinct(), RADIUS), "a", "b")
    found = sets.select("fp", "mark").join(near, F.col("mark") == F.col("node"), "left")
    band = F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "mark"))
    return materialize(found.select("fp", band.alias("band")), "jaccard-marks")


def keep_one(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    unit_rows: int = 2000,
) -> DataFrame:
    """The rows of ``df``, all columns, with one row for each near-duplicate group: the smallest id.

    Candidates are found by SimHash fingerprints and, further apart, by min-hash bands; each link is then checked exactly.
    Two texts link if their sets of ``width``-word shingles have a Jaccard similarity of at least
    ``similarity`` (0.8 or more); a group is what hangs together by links.  Null, empty and wordless
    texts have equal sets.  Rows without an id take part and stay.  Rows that repeat the
    kept id and text come once; an id with two unlike texts keeps both.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity must be 0.8 to 1: the bands are proven from 0.8 on")
    spark = df.sparkSession
    small_batches(spark)
    rows = materialize(_rows(df, id_col, text_col, width), "jaccard-rows")
    named = F.struct("id", "key")
    best = F.min(F.when(F.col("id").isNotNull(), named)).alias("best")
    sets = materialize(
        rows.groupBy("fp").agg(best, F.min(named).alias("any"), F.min("mark").alias("mark")), "jaccard-sets"
    )
    filed = rows.select("fp", F.explode("bands").alias("band")).unionByName(_marked(sets))
    heads = filed.groupBy("band").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).filter("head < last")
    heads = materialize(heads.select("band", "head"), "jaccard-heads")
    filed = sieved(filed, heads, "band").filter("__maybe").select("fp", "band")
    groups = components(filed.join(heads, "band").select("fp", "head"), "fp", "head")
    units = cells(groups.select(F.col("node").alias("fp"), F.col("root").alias("unit")), unit_rows)

    # One row of the table for each set gives the text.
    shown = sets.select("fp", F.coalesce("best", "any").alias("row")).join(units.select("fp").distinct(), "fp")
    shown = materialize(shown.select("fp", F.col("row.id").alias("id"), F.col("row.key").alias("key")), "jaccard-shown")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = sieved(texts, shown, "id", "key").filter("__maybe")
    shown = shown.withColumnsRenamed({"id": "__id", "key": "__key"})
    texts = texts.join(shown, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id"))).select("fp", "text")
    links = _links(texts.join(units, "fp"), partitions(df), width, Fraction(str(similarity)))

    reach = components(links, "a", "b").select(F.col("node").alias("fp"), "root")
    roots = sets.select("fp", "best").join(reach, "fp", "left").select("best", F.coalesce("root", "fp").alias("root"))
    kept = roots.groupBy("root").agg(F.min("best").alias("best")).filter("best is not null")
    kept = materialize(kept.select("best.id", "best.key"), "jaccard-kept")
    # Rows whose id and text come once and are kept need no join: only names that go or repeat are in doubt.
    names = rows.filter("id is not null").groupBy("id", "key").agg(F.count("*").alias("n"))
    names = names.join(kept.withColumn("stays", F.lit(True)), ["id", "key"], "left")
    doubtful = materialize(names.filter("n > 1 or stays is null").select("id", "key"), "jaccard-doubtful")
    named = {"id": id_col, "key": "__text_key"}
    keyed = df.withColumn("__text_key", F.xxhash64(text_col))
    keyed = sieved(keyed, doubtful.withColumnsRenamed(named), id_col, "__text_key")
    sure = F.col(id_col).isNull() | ~F.col("__maybe")
    stay = keyed.filter(~sure).join(kept.withColumnsRenamed(named), [id_col, "__text_key"], "left_semi")
    stay = stay.dropDuplicates([id_col, "__text_key"])
    return keyed.filter(sure).unionByName(stay).select(*df.columns)
