"""Evaluation metrics as aggregates.

Rank metrics work on value counts (``value_ranks``), so ties are exact and one
horizon or fold may hold any share of the rows.  ``by`` adds grouping columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.expr import ratio
from barloom.operators.ranking import average_rank, value_ranks, with_ordinal


def _agg(df: DataFrame, by: Sequence[str], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def roc_auc(
    df: DataFrame,
    y: str,
    score: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    one_class: float | None = None,
    out: str = "auc",
) -> DataFrame:
    """Rank-sum AUC with tie-averaged ranks; ``one_class`` replaces NULL."""
    clean = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    if weight is None:
        ranks = value_ranks(clean, by, score, {"pos": F.sum(F.col(y).cast("double"))})
        sums = _agg(
            ranks,
            by,
            F.sum(F.col("pos") * average_rank()).alias("__u"),
            F.sum("pos").alias("__p"),
            F.sum(F.col("n").cast("double")).alias("__n"),
        )
        u = F.col("__u") - F.col("__p") * (F.col("__p") + 1) / 2
        value = ratio(u, F.col("__p") * (F.col("__n") - F.col("__p")))
    else:
        w = F.col(weight)
        ranks = _weighted_counts(clean, by, score, w * F.col(y), w * (1 - F.col(y)))
        sums = _agg(
            ranks,
            by,
            F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("__u"),
            F.sum("pos").alias("__p"),
            F.sum("neg").alias("__q"),
        )
        value = ratio(F.col("__u"), F.col("__p") * F.col("__q"))
    if one_class is not None:
        value = F.coalesce(value, F.lit(one_class))
    return sums.select(*by, value.alias(out))


def _weighted_counts(df: DataFrame, by: Sequence[str], score: str, pos: Column, neg: Column) -> DataFrame:
    """Positive and negative weight per distinct score, with the negative weight below."""
    from barloom.operators.ranking import order_bucket

    values = (
        df.groupBy(*by, score)
        .agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))
        .withColumn("__b", order_bucket(F.col(score)))
    )
    along = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__b")
    base = values.groupBy(*by, "__b").agg(F.sum("neg").alias("__t")).select(
        *by, "__b", F.coalesce(F.sum("__t").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before")
    )
    inside = Window.partitionBy(*by, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("__before") + F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    return values.join(base, [*by, "__b"]).withColumn("neg_below", below)


def accuracy(y: Column, pred: Column) -> Column:
    return F.avg((y == pred).cast("double"))


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def brier_classes(y: Column, proba: Column) -> Column:
    """Mean squared distance to the one-hot class; ``proba`` is an array."""
    gap = F.transform(proba, lambda p, i: F.pow(p - F.when(i == y, 1.0).otherwise(0.0), 2.0))
    return F.avg(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x))


def log_loss(y: Column, p: Column, eps: float = 2.220446049250313e-16) -> Column:
    clipped = F.greatest(F.least(p, F.lit(1.0 - eps)), F.lit(eps))
    return -F.avg(F.when(y == 1, F.log(clipped)).otherwise(F.log(1.0 - clipped)))


def classification_report(df: DataFrame, y: str, pred: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy, balanced_accuracy, log_loss, brier (binary)."""
    yy, pp, pr = F.col(y), F.col(p), F.col(pred)
    hit = (yy == pr).cast("double")
    recall = [F.avg(F.when(yy == k, hit)) for k in (0, 1)]
    present = F.size(F.array_compact(F.array(*recall)))
    balanced = (F.coalesce(recall[0], F.lit(0.0)) + F.coalesce(recall[1], F.lit(0.0))) / present
    return _agg(
        df,
        by,
        F.avg(hit).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        log_loss(yy, pp).alias("log_loss"),
        # The two-column form counts both classes, hence twice the binary score.
        (2 * brier(yy, pp)).alias("brier"),
    )


def information_coefficient(df: DataFrame, y: str, p: str, by: Sequence[str] = (), out: str = "ic") -> DataFrame:
    """Spearman correlation with tie-averaged ranks.

    Equal (y, p) pairs are merged first, so a common score cannot pile up in one
    join partition; the correlation then uses the counts.
    """
    by = list(by)
    pairs = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, y, p)
    pairs = pairs.agg(F.count(F.lit(1)).cast("double").alias("__c"))
    full = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    ry = value_ranks(full, by, y).select(*by, y, average_rank().alias("__ry"), "total")
    rp = value_ranks(full, by, p).select(*by, p, average_rank().alias("__rp"))
    j = pairs.join(ry, [*by, y]).join(rp, [*by, p])
    mid = (F.col("total") + 1) / 2.0
    a, b, c = F.col("__ry") - mid, F.col("__rp") - mid, F.col("__c")
    sums = _agg(j, by, F.sum(c * a * b).alias("__ab"), F.sum(c * a * a).alias("__aa"), F.sum(c * b * b).alias("__bb"))
    return sums.select(*by, ratio(F.col("__ab"), F.sqrt(F.col("__aa") * F.col("__bb"))).alias(out))


def directional_accuracy(y: Column, p: Column) -> Column:
    """Share of right signs where the outcome is not zero and nothing is missing."""
    return F.avg(F.when((y != 0) & p.isNotNull(), (F.signum(p) == F.signum(y)).cast("double")))


def pinball(y: Column, p: Column, tau: float) -> Column:
    d = y - p
    return F.avg(F.when(d.isNotNull(), F.greatest(tau * d, (tau - 1.0) * d)))


def regression_report(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, r2, directional_accuracy, ic."""
    yy, pp = F.col(y), F.col(p)
    e = yy - pp
    spread = F.var_pop(yy)
    one = _agg(
        df,
        by,
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - ratio(F.avg(e * e), spread)).alias("r2"),
        directional_accuracy(yy, pp).alias("directional_accuracy"),
    )
    ic = information_coefficient(df, y, p, by)
    return one.join(ic, list(by)) if by else one.withColumn("ic", ic.scalar())


def class_table(df: DataFrame, y: str, pred: str) -> DataFrame:
    """precision, recall, f1, support per class, plus accuracy, macro and weighted rows."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")),
                F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")),
            )
        ).alias("s"),
        F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
    )
    per = sides.groupBy("s.class").agg(
        F.sum("s.support").alias("support"),
        F.sum("s.called").alias("called"),
        # Every hit cell appears on both sides.
        (F.sum("hit") / 2).alias("hit"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("hit"), F.col("called")), zero)
    recall = F.coalesce(ratio(F.col("hit"), F.col("support")), zero)
    per = per.select("class", precision.alias("precision"), recall.alias("recall"), "support", "hit").withColumn(
        "f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    )
    names = ("precision", "recall", "f1")
    rows = per.select(F.col("class").cast("string").alias("row"), *names, "support")
    macro = per.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = per.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    right = F.sum("hit") / F.sum("support")
    acc = per.agg(*[right.alias(c) for c in names], F.sum("support").alias("support"))
    tail = [d.select(F.lit(n).alias("row"), *names, "support") for n, d in
            (("accuracy", acc), ("macro avg", macro), ("weighted avg", weighted))]
    for d in tail:
        rows = rows.unionByName(d)
    return rows


def band_report(df: DataFrame, y: str = "y", by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Coverage of the outer and inner band, mean width, half width in percent."""
    yy = F.col(y)
    width = F.avg(F.col("q95") - F.col("q05"))
    return _agg(
        df.filter(yy.isNotNull()),
        by,
        F.avg(yy.between(F.col("q05"), F.col("q95")).cast("double")).alias("cover90"),
        F.avg(yy.between(F.col("q25"), F.col("q75")).cast("double")).alias("cover50"),
        width.alias("width90"),
        (F.expm1(width / 2) * 100).alias("half_band_pct"),
    )


def price_cone(df: DataFrame, by: Sequence[str] = ("horizon",), start: float = 100.0) -> DataFrame:
    """start * exp(mean quantile) per horizon."""
    taus = ("q05", "q25", "q50", "q75", "q95")
    return _agg(df, by, *[(start * F.exp(F.avg(q))).alias(q.replace("q", "p")) for q in taus])


COVERAGES = (1.0, 0.5, 0.3, 0.2, 0.1, 0.05)  # fixed values


def selective_accuracy(
    df: DataFrame, y: str, p: str, ties: Sequence[str], by: Sequence[str] = ("horizon",)
) -> DataFrame:
    """Accuracy on the most confident share of rows, at the fixed coverages.

    Confidence is |p - 0.5|; at least one row is kept.  Rows are numbered per
    (group, confidence bucket), so a horizon is not sorted in one task.
    """
    by = list(by)
    base = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("__c", -F.abs(F.col(p) - 0.5))
    ranked = with_ordinal(base, by, "__c", list(ties), "__k")
    total = _agg(base, by, F.count(F.lit(1)).alias("__n"))
    ranked = ranked.join(total, by) if by else ranked.withColumn("__n", total.scalar())
    hit = ((F.col(p) >= 0.5) == (F.col(y) >= 0.5)).cast("double")
    cols = []
    for c in COVERAGES:
        top = F.greatest(F.lit(1), F.floor(F.lit(c) * F.col("__n")))
        cols.append(F.avg(F.when(F.col("__k") <= top, hit)).alias(f"acc_cov{round(c * 100)}"))
    return _agg(ranked, by, *cols)


def curvature(df: DataFrame, p: str, keys: Sequence[str], order: str = "horizon") -> DataFrame:
    """Mean squared second difference of p along the horizons of a row."""
    path = Window.partitionBy(*keys).orderBy(order)
    bend = F.lead(p).over(path) - 2 * F.col(p) + F.lag(p).over(path)
    return df.select(bend.alias("__b")).agg(F.avg(F.col("__b") * F.col("__b")).alias("curvature"))


def compare_tables(coupled: DataFrame, independent: DataFrame, value: str = "auc") -> DataFrame:
    """Two per-horizon tables side by side with the difference and a mean row."""
    a = independent.select(F.col("horizon").cast("string").alias("horizon"), F.col(value).alias("independent"))
    b = coupled.select(F.col("horizon").cast("string").alias("horizon"), F.col(value).alias("coupled"))
    both = a.join(b, "horizon")
    mean = both.agg(F.lit("mean").alias("horizon"), F.avg("independent").alias("independent"), F.avg("coupled").alias("coupled"))
    return both.unionByName(mean).withColumn("delta", F.col("coupled") - F.col("independent"))


def majority_baseline(y: Column) -> Column:
    return F.greatest(F.avg(y), 1 - F.avg(y))


def fold_summary(metrics: DataFrame, acc: str = "acc", auc: str = "auc") -> DataFrame:
    return metrics.agg(
        F.avg(acc).alias("mean_acc"),
        F.avg(auc).alias("mean_auc"),
        F.stddev_pop(auc).alias("std_auc"),
        F.count(F.lit(1)).alias("n_paths"),
    )
