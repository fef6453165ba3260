"""Threshold-scaled document sketches, as DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range.  The
fraction does not depend on the document, so two sketches of very unequal documents
sample the same hashes: the share of the smaller sketch found in the larger one
estimates containment, and the sketch of a union is the union of the sketches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import bind, partitions, words

# A kept value is the top 32 + bits of a hash; below this it is under the fraction.
KEPT = 1 << 32


def _scaled_hashes(text: Column, width: int, bits: int) -> Column:
    """The hash of every ``width``-word shingle, cut to its top ``32 + bits`` bits."""
    hashed = F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - width)
        every = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(
            F.when(F.size(h) >= width, every).otherwise(whole), lambda x: F.shiftrightunsigned(x, 32 - bits)
        )

    return bind(hashed, shingles)


def sketch(text: Column, width: int = 5, bits: int = 3) -> Column:
    """Sorted distinct hashes under the fraction ``2 ** -bits``, as array<bigint>.

    Words are lower-cased; a text of fewer than ``width`` words is one shingle.  A text
    with words of which no hash is under the fraction keeps its smallest one, so
    only null, empty and wordless texts have empty sketches.
    """
    if not 0 <= bits <= 16:
        raise ValueError("bits must be 0 to 16")
    return bind(_scaled_hashes(text, width, bits), _under)


def _under(values: Column) -> Column:
    low = F.array_sort(F.array_distinct(F.filter(values, lambda v: v < KEPT)))
    some = F.size(values) > 0
    return bind(low, lambda k: F.when((F.size(k) > 0) | ~some, k).otherwise(F.array(F.array_min(values))))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together."""
    return bind(F.array_union(a, b), _under)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the larger one has.

    Two empty sketches are alike (1), an empty and a filled one are not (0).
    """
    smaller = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)) / smaller
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(smaller == 0, 0.0).otherwise(shared)


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal numbers joined by commas; equal sketches give equal strings."""
    return F.array_join(F.transform(a, lambda v: F.lower(F.hex(v))), ",")


def _upto(cuts: list[float], x: Column) -> Column:
    """How many of the sorted ``cuts`` are at most x: first among every k-th of them, then in the k that follow.

    With k the root of their number, a row meets two short lists and not every cut.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    every, heads = F.lit(cuts), F.lit(cuts[::step])

    def inside(block: Column) -> Column:
        low = (block - 1) * step
        return low + F.size(F.filter(F.slice(every, low + 1, F.lit(step)), lambda c: c <= x))

    return bind(F.size(F.filter(heads, lambda c: c <= x)), lambda b: F.when(b == 0, 0).otherwise(inside(b)))


def with_next(df: DataFrame, id_col: str, carry: list[str], tie: str, per_partition: int = 4) -> DataFrame:
    """Add ``next_<c>`` for each column of ``carry``: its value in the row with the next id.

    The row after the last is the first.  Rows of one id follow in order of ``tie``; rows
    without an id come first.  Ids must be numeric.  Rows are shuffled once: quantiles
    of the ids cut them into ranges, and each range also gets a copy of the row that
    opens the range after it.
    """
    ranges = per_partition * partitions(df)
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", steps, 0.25 / ranges)))
    home = F.when(F.col(id_col).isNull(), 0).otherwise(_upto(cuts, F.col(id_col).cast("double")) + 1)

    # One row a range, so this is as short as the list of cuts.
    opens = dict(df.groupBy(home.alias("home")).agg(F.min(id_col).alias("low")).collect())
    if not opens:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in carry))
    used = sorted(opens)
    before = {at: used[i - 1] for i, at in enumerate(used)}
    kind = dict(df.dtypes)[id_col]
    low = F.array(*(F.lit(opens.get(at)).cast(kind) for at in range(used[-1] + 1)))
    back = F.array(*(F.lit(before.get(at, at)) for at in range(used[-1] + 1)))

    def place(at: Column) -> Column:
        own = F.struct(at.alias("home"), F.lit(False).alias("copy"))
        lent = F.struct(F.get(back, at).alias("home"), F.lit(True).alias("copy"))
        opening = F.col(id_col).eqNullSafe(F.get(low, at))
        return F.when(opening, F.array(own, lent)).otherwise(F.array(own))

    dealt = df.withColumn("__places", bind(home, place)).select(
        *(F.col(c) for c in df.columns), F.inline("__places").alias("__home", "__copy")
    )
    along = Window.partitionBy("__home").orderBy("__copy", F.asc_nulls_first(id_col), F.asc_nulls_first(tie))
    follows = F.lead(F.struct(*carry)).over(along)
    return (
        dealt.withColumn("__next", follows)
        .filter(~F.col("__copy"))
        .select(*df.columns, *(F.col(f"__next.{c}").alias(f"next_{c}") for c in carry))
    )


def edited_likeness(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bits: int = 2
) -> DataFrame:
    """Sketches of each text, of its edited form and of the next text, and how alike they are.

    Edited: the last quarter of the code points (rounded down) gives way to as many
    from the start of the next text (all of it if shorter).  Columns: id_col, n_chars,
    edited, sketch, edited_sketch, near_edited, near_next.  Null texts count as empty;
    a single row is its own next; repeated rows are repeated; an empty table gives none.
    """
    own = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("sketch", sketch(F.col("text"), width, bits))
    linked = with_next(own, "id", ["text", "sketch"], "text").withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)
    )
    return (
        linked.withColumn("edited", edited)
        .withColumn("edited_sketch", sketch(F.col("edited"), width, bits))
        .select(
            F.col("id").alias(id_col),
            "n_chars",
            "edited",
            "sketch",
            "edited_sketch",
            containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
            containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        )
    )
