"""Quality rules whose cutoffs carry a guarantee, as DataFrame functions only.

Each rule compares a share of a document (symbols, repeated lines, repeated words)
with a cutoff.  Cutoffs come from labelled documents: in every stratum, a cutoff may be used
only if an exact binomial test shows that it wrongly rejects at most a set share of good
documents.  The error of the tests is divided by the number of rules and strata; within
one rule and stratum cutoffs are tested from the loosest on, which costs nothing more.
Among the proven cutoffs the one with the best balance of bad and good rejections is taken, the loosest
of equals; a rule that does more harm than good, or that too few labels can prove,
gets none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import SPACES, WORD, bind, words
from barloom.session import materialize

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
# rule: (part, whole); a document is rejected if part / whole is above the cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
WINDOW = 3


def _repeated(w: Column) -> Column:
    """Words of an array that lie in a three-word window found twice or more."""

    def marked(windows: Column) -> Column:
        tagged = F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("at")))
        return bind(F.sort_array(tagged), lambda s: F.size(F.array_distinct(F.flatten(_covered(s)))))

    def _covered(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: F.coalesce(x["g"] == F.get(s, k - 1)["g"], F.lit(False))
            | F.coalesce(x["g"] == F.get(s, k + 1)["g"], F.lit(False)),
        )
        return F.transform(twice, lambda x: F.array(*(x["at"] + k for k in range(WINDOW))))

    def count(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        repeats = bind(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(marked(g)))
        return F.when(F.size(h) < WINDOW, 0).otherwise(repeats)

    return bind(F.transform(w, lambda x: F.xxhash64(x)), count)


def measures(text: Column) -> Column:
    """A struct of the counts in ``MEASURES`` (long) for a whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_words = bind(words(text), lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    both = F.struct(of_words.alias("w"), of_lines.alias("l"))
    return bind(
        both,
        lambda b: F.struct(
            b["w"]["n_words"].cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            b["l"]["n"].cast("long").alias("n_lines"),
            b["l"]["dup"].cast("long").alias("n_dup_lines"),
            b["w"]["n_repeat_words"].cast("long").alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Risk:
    """Limits of the choice of cutoffs.

    ``rate``: largest share of a stratum's good documents that all rules together may wrongly reject.
    ``error``: probability that any of those limits is broken.  ``cost``: bad documents that must go
    for each good one.  ``steps``: cutoffs are multiples of 1 / steps.
    """

    rate: float = 0.1
    error: float = 0.05
    cost: float = 10.0
    steps: int = 100


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Too short, or more than half of it repeated."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms; 1 from the mean on, where no test passes."""
    ratio = F.log(F.lit(p / (1 - p)))
    first = n * F.log1p(F.lit(-p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + ratio
        high, gap = F.greatest(acc["sum"], term), F.abs(acc["sum"] - term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(-gap))).alias("sum"))

    start = F.struct(first.alias("term"), first.alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, 1.0).otherwise(F.exp(F.aggregate(steps, start, add, lambda acc: acc["sum"])))


def _last_step(part: Column, whole: Column, steps: int) -> Column:
    """The largest cutoff number that still rejects part / whole, in integers; -1 for none."""
    return F.when(part > 0, F.floor((steps * part - 1) / whole)).otherwise(-1).cast("long")


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str, stratum: str, digest: str, risk: Risk) -> DataFrame:
    """(stratum, one column per rule): cutoff numbers out of ``risk.steps``, null for no cutoff.

    ``measured`` has id_col, the stratum, a digest of the text and the measures; ``labels`` has
    doc_id and quality (1 good, 0 bad, else ignored).  Texts that repeat count once,
    as trials must not depend on each other; labels that contradict each other do not count.
    """
    marks = (
        labels.filter(F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.min("quality").alias("__low"), F.max("quality").alias("__high"))
    )
    trials = (
        measured.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .join(marks, F.col(id_col) == F.col("__id"))
        .groupBy(stratum, digest)
        .agg(F.min("__low").alias("low"), F.max("__high").alias("high"), *(F.first(m).alias(m) for m in MEASURES))
        .filter("low = high")
    )
    rules = F.array(
        *(
            F.struct(F.lit(name).alias("rule"), _last_step(F.col(part), F.col(whole), risk.steps).alias("step"))
            for name, (part, whole) in RULES.items()
        )
    )
    counts = materialize(
        trials.select(stratum, "high", F.inline(rules))
        .groupBy(stratum, "rule", "step")
        .agg(F.sum("high").alias("good"), F.sum(1 - F.col("high")).alias("bad")),
        "quality-counts",
    )
    tests = max(1, counts.select(stratum).distinct().count()) * len(RULES)
    group = Window.partitionBy(stratum, "rule")
    loosest_first = group.orderBy(F.desc("step"))
    tried = (
        counts.withColumn("n", F.sum("good").over(group))
        .withColumn("k", F.sum("good").over(loosest_first))
        .withColumn("caught", F.sum("bad").over(loosest_first))
        .filter("step >= 0")
    )
    tail = binomial_tail(F.col("k").cast("long"), F.col("n").cast("long"), risk.rate / len(RULES))
    gain = F.col("caught") - risk.cost * F.col("k")
    best = (
        tried.filter(tail <= risk.error / tests)
        .filter(gain > 0)
        .groupBy(stratum, "rule")
        .agg(F.max(F.struct(gain.alias("gain"), F.col("step").alias("step")))["step"].alias("step"))
    )
    return best.groupBy(stratum).agg(
        *(F.max(F.when(F.col("rule") == name, F.col("step"))).alias(f"__cut_{name}") for name in RULES)
    )


def judged(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    stratum_col: str = "lang",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    risk: Risk | None = None,
) -> DataFrame:
    """One row for each row of ``df``: id, the measures, base_failed, kept and, as ``row``, the columns in ``carry``.

    kept is false for documents that fail the base rules or are above a cutoff of their
    stratum; null is a stratum of its own.  Without labels no cutoff is proven and
    only the base rules reject.  Null texts count as empty and fail the base.  Repeated rows are
    repeated; an empty table gives none.
    """
    risk = risk or Risk()
    measured = materialize(
        df.select(
            F.col(id_col).alias("id"),
            F.col(stratum_col).alias("stratum"),
            F.xxhash64(text_col).alias("digest"),
            F.struct(*(F.col(c) for c in carry or (id_col,))).alias("row"),
            measures(F.col(text_col)).alias("m"),
        ),
        "quality-measures",
    ).select("id", "stratum", "digest", "row", "m.*")
    cuts = cutoffs(measured, labels, "id", "stratum", "digest", risk).withColumnRenamed("stratum", "__stratum")
    joined = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    above = [
        F.coalesce(risk.steps * F.col(part) > F.col(f"__cut_{name}") * F.col(whole), F.lit(False))
        for name, (part, whole) in RULES.items()
    ]
    rejected = failed
    for one in above:
        rejected = rejected | one
    return joined.select("id", "row", *MEASURES, failed.alias("base_failed"), (~rejected).alias("kept"))


def kept_rows(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns."""
    found = judged(df, labels, carry=tuple(df.columns), **options)
    return found.filter("kept").select(*(F.col("row")[c].alias(c) for c in df.columns))
