"""How far the sources of a language differ in their words, over collapsed duplicate texts.

Identical texts of a language become one row with the number of copies in each source.  Each
such text is split into terms once; its counts and document frequencies are added with those
numbers as weights.  Sources are then compared on the terms that enough documents have:
smoothed frequencies are whole billionths, so every sum is exact.

A pair of sources is summed over tiles of terms.  A tile holds the frequencies of one block of
sources (or two) for a bounded number of terms and gives one partial sum per pair; terms
that no source of the tile's blocks has are added by their number.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, UPPER, ship, small_batches
from barloom.session import materialize

ship(__name__)

# Terms are runs of letters A-Z and of bytes beyond ASCII: all else becomes a space.
_KEPT = {ord(c) for c in UPPER + LOWER} | set(range(128, 256))
TERM_BYTES = bytes(b + 32 if chr(b) in UPPER else b if b in _KEPT else 32 for b in range(256))

# Distinct (source, term) entries that a task holds before it hands them on.
ENTRIES = 500_000
# Bytes of whole texts that a task collapses before it hands them on.
HELD_BYTES = 32 << 20
SOURCES_PER_BLOCK, TERMS_PER_TILE = 64, 2048
UNIT = 1_000_000_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def collapsed(rows: DataFrame) -> DataFrame:
    """(lang, text, copies): each text of a language once, with (source, n) for the sources that have it.

    Each task first collapses what it reads, so a text that a third of all rows share arrives as
    a few rows per task, and whole texts are shuffled once.  A source may be listed more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = defaultdict(Counter)
        size = 0

        def handed() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for at in range(0, len(keys), 1000):
                part = keys[at : at + 1000]
                copies = [[{"source": s, "n": n} for s, n in held[k].items()] for k in part]
                columns = [pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(copies, kind)], names=["lang", "text", "copies"])
            held.clear()

        kind = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                held[lang, text][source] += 1
            size += batch.column(2).nbytes
            if size > HELD_BYTES:
                yield from handed()
                size = 0
        yield from handed()

    local = rows.select("lang", "source", F.col("text").cast("binary")).mapInArrow(
        run, "lang string, text binary, copies array<struct<source string, n long>>"
    )
    return local.repartition("lang", "text").groupBy("lang", "text").agg(F.flatten(F.collect_list("copies")).alias("copies"))


def term_counts(rows: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs, lang_n): occurrences in the source; documents and occurrences in the language.

    All are counted over all copies.  A task hands on one row per source and term; rows are
    shuffled once, by term, and every later sum is taken there.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        docs: dict[tuple, Counter] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                # Neighbours in byte order share their beginnings, which compresses well.
                names, seen = sorted(found), docs[lang, source]
                for at in range(0, len(names), 20_000):
                    part = names[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(pa.scalar(lang, pa.string()), len(part)),
                            pa.repeat(pa.scalar(source, pa.string()), len(part)),
                            pa.array(part, pa.binary()).cast(pa.string()),
                            pa.array([found[t] for t in part], pa.int64()),
                            pa.array([seen[t] for t in part], pa.int64()),
                        ],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            counts.clear()
            docs.clear()

        for batch in batches:
            for lang, text, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                found = terms(text.as_py())
                if len(copies) == 1 and copies[0]["n"] == 1:
                    key = lang, copies[0]["source"]
                    counts[key].update(found)
                    docs[key].update(set(found))
                    continue
                once = Counter(found)
                for copy in copies:
                    n, into, seen = copy["n"], counts[lang, copy["source"]], docs[lang, copy["source"]]
                    for term, k in once.items():
                        into[term] += n * k
                        seen[term] += n
            if sum(map(len, counts.values())) > ENTRIES:
                yield from handed()
        yield from handed()

    partial = collapsed(rows).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    summed = partial.repartition("lang", "term").groupBy("lang", "term", "source")
    summed = summed.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return summed.select(
        "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n")
    )


def frequency(n: Column, total: Column, kept: Column, prior: int) -> Column:
    """1 + floor(billionths of (n + prior) / (total + prior * kept)), exact at any size; 0 without kept terms."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + prior).cast("decimal(20,0)")
    whole = F.call_function("div", above, (total + prior * kept).cast("decimal(20,0)"))
    return F.when(kept > 0, 1 + whole).otherwise(F.lit(0).cast("long"))


def _tile_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Partial sums of every pair of sources of a tile; a row without term tells a source's default."""
    first, second = key[2].as_py(), key[3].as_py()
    source, block = table.column("position").to_numpy(), table.column("block").to_numpy()
    absent = np.asarray(table.column("term").is_null())
    known = table.column("term").filter(pa.array(~absent)).combine_chunks().dictionary_encode()
    width = len(known.dictionary)
    names, at = np.unique(source[absent], return_index=True)
    freq = np.repeat(table.column("p").to_numpy()[absent][at][:, None], width, axis=1)
    where = np.searchsorted(names, source[~absent])
    freq[where, known.indices.to_numpy()] = table.column("p").to_numpy()[~absent]
    side = block[absent][at]
    out: dict[str, list] = {"a": [], "b": [], "value": []}
    for i in np.flatnonzero(side == first):
        others = np.flatnonzero((side == second) & (names > names[i]) if first == second else side == second)
        out["a"].append(np.full(len(others), names[i]))
        out["b"].append(names[others])
        out["value"].append(np.abs(freq[others] - freq[i]).sum(axis=1))
    columns = {k: np.concatenate([np.empty(0, np.int64), *v]).astype(np.int64) for k, v in out.items()}
    size = len(columns["a"])
    return pa.table(
        {"lang": pa.repeat(key[0], size).cast(pa.string()), **columns, "width": np.full(size, width, dtype=np.int64)}
    )


def pair_distances(sources: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    tiles = F.greatest(F.lit(1), F.ceil(F.col("V") / TERMS_PER_TILE)).cast("long")
    placed = sources.withColumn("tiles", tiles).withColumn("block", F.floor(F.col("position") / SOURCES_PER_BLOCK))
    blocks = placed.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    placed = placed.join(blocks, "lang")
    common = ["lang", "position", "block", "blocks"]
    filled = kept.join(placed, ["lang", "source"]).select(
        *common, F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), "term", "p"
    )
    default = placed.select(
        *common, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"),
        F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"),
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = filled.union(default).withColumn("other", other)
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    sums = (
        dealt.groupBy("lang", "tile", "first", "second")
        .applyInArrow(_tile_sums, "lang string, a long, b long, value long, width long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"), F.sum("width").alias("width"))
    )
    named = sources.select("lang", "position", "source", "zero", "V")
    left, right = (named.select("lang", *(F.col(c).alias(f"{s}_{c}") for c in named.columns[1:])) for s in "ab")
    found = sums.join(left.withColumnRenamed("a_position", "a"), ["lang", "a"]).join(
        right.withColumnRenamed("b_position", "b"), ["lang", "b"]
    )
    unseen = (F.col("a_V") - F.col("width")) * F.abs(F.col("a_zero") - F.col("b_zero"))
    found = found.select("lang", "a_source", "b_source", (F.col("value") + unseen).alias("value"))
    ways = (("a_source", "b_source"), ("b_source", "a_source"))
    both = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ways))
    return found.select("lang", F.inline(both), "value")


def divergence(
    df: DataFrame,
    min_docs: int = 30,
    prior: int = 5,
    top: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and terms a source uses more.

    A language keeps the terms of at least ``min_docs`` of its documents.  Part ``pair``: the summed
    difference of the smoothed frequencies (in billionths) to each other source of the language.
    Part ``term``: the ``top`` kept terms that stand out against the whole language.  Ranks run by
    value, then by item in byte order.  Null text, lang and source read as empty; every
    occurring (lang, source) takes part, also without a term; without kept terms distances
    are 0.  Repeated rows count each; an empty table gives none; other columns are ignored.
    """
    rows = df.select(
        *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text")))
    )
    kept = materialize(term_counts(rows).filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    enough = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))

    # One row a source, small beside the texts.
    vocabulary = enough.groupBy("lang").agg(F.count("*").alias("V"), F.sum("lang_n").alias("lang_size"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    sources = (
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    ).fillna(0, ["size", "V", "lang_size"])
    zero = frequency(F.lit(0), F.col("size"), F.col("V"), prior)
    position = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    sources = materialize(sources.withColumn("zero", zero).withColumn("position", position), "divergence-sources")

    scaled = kept.join(sources, ["lang", "source"]).select(
        "lang", "source", "term", frequency(F.col("n"), F.col("size"), F.col("V"), prior).alias("p"),
        frequency(F.col("lang_n"), F.col("lang_size"), F.col("V"), prior).alias("q"),
    )
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_distances(sources, scaled.drop("q")).withColumn("rank", ranked)
    standing = scaled.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    standing = standing.withColumn("rank", ranked).filter(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(standing.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")
    )
