"""Registered queries: splits and weights."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from barloom.operators import splits as S
from barloom.plans.registry import query, rounded
from barloom.plans.sqltext import DAILY, WIDE
from barloom.sources.datasets import daily_panel, wide_panel

KEY = ["ticker", "date"]
DATES = """dates AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n
 FROM (SELECT DISTINCT date FROM daily))"""
FOLDS = """ sp AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
 folds AS (SELECT k AS fold, lo AS train_start, CAST(lo + to_years(CAST(2 + k AS INTEGER)) AS DATE) AS train_end, CAST(lo + to_years(CAST(2 + k AS INTEGER)) AS DATE) AS val_start,
  CAST(lo + to_years(CAST(3 + k AS INTEGER)) AS DATE) AS val_end, CAST(lo + to_years(CAST(3 + k AS INTEGER)) AS DATE) AS test_start,
  CAST(lo + to_years(CAST(4 + k AS INTEGER)) AS DATE) AS test_end, hi FROM sp, range(0, 20) t(k)
  WHERE CAST(lo + to_years(CAST(4 + k AS INTEGER)) AS DATE) <= hi + 1)"""


def _folds(spark, sf_dir):
    daily = daily_panel(spark, sf_dir)
    return daily, S.walk_forward_folds(daily, 2, 1, 1, 1)


@query(
    "v01_walk_forward_folds",
    f"""WITH {DAILY}, {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, CAST(test_start AS VARCHAR) || '_to_' || CAST(test_end AS VARCHAR) AS name,
 train_start, train_end, val_start, val_end, test_start, test_end FROM folds""",
)
def v01(spark, sf_dir):
    return _folds(spark, sf_dir)[1]


@query(
    "v02_purge_embargo",
    f"""WITH {DAILY}, {FOLDS} SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_kept, count(DISTINCT date) AS n_dates FROM daily JOIN folds
 ON date < test_start - 20 OR date > test_end + 20 GROUP BY 1""",
)
def v02(spark, sf_dir):
    daily, folds = _folds(spark, sf_dir)
    table = folds.agg(F.collect_list(F.struct("fold", "test_start", "test_end"))).scalar()
    per_date = daily.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    each = per_date.select("date", "rows", F.explode(table).alias("f"))
    kept = each.filter(S.purged(F.col("date"), F.col("f.test_start"), F.col("f.test_end")))
    return kept.groupBy(F.col("f.fold").alias("fold")).agg(
        F.sum("rows").alias("n_kept"), F.count(F.lit(1)).alias("n_dates")
    )


@query(
    "v03_fold_roles",
    f"""WITH {DAILY}, {FOLDS}, r AS (SELECT ticker, date, CAST(fold AS INTEGER) AS fold,
  CASE WHEN date >= test_start AND date < test_end THEN 'test' WHEN date >= val_start AND date < val_end THEN 'val'
   WHEN date >= train_start AND date < train_end AND (date < test_start - 20 OR date > test_end + 20) THEN 'train' END AS role
  FROM daily, folds) SELECT ticker, date, fold, role FROM r WHERE role IS NOT NULL""",
)
def v03(spark, sf_dir):
    daily, folds = _folds(spark, sf_dir)
    roles = S.walk_forward_roles(daily, folds)
    return S.with_roles(daily.select(*KEY), roles).select(*KEY, "fold", "role")


def _blocks(purge: int, min_train: int, min_test: int) -> str:
    return f"""WITH {DAILY}, {DATES}, r AS (SELECT ticker, date, CAST(k AS INTEGER) AS fold,
  CASE WHEN p < greatest(0, (k + 1) * (n // 6) - {purge}) THEN 'train'
   WHEN p >= (k + 1) * (n // 6) AND p < least((k + 2) * (n // 6), n - 1) THEN 'test' END AS role
  FROM daily JOIN dates USING (date), range(0, 5) t(k)),
 g AS (SELECT fold FROM r GROUP BY 1 HAVING count(CASE WHEN role = 'train' THEN 1 END) >= {min_train} AND count(CASE WHEN role = 'test' THEN 1 END) >= {min_test})
 SELECT fold, role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM r SEMI JOIN g USING (fold) WHERE role IS NOT NULL GROUP BY 1, 2"""


def _block_summary(daily, roles):
    return (
        S.with_roles(daily.select(*KEY), roles)
        .groupBy("fold", "role")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )


@query("v04_block_folds_purged", _blocks(20, 500, 50))
def v04(spark, sf_dir):
    daily = daily_panel(spark, sf_dir)
    return _block_summary(daily, S.block_folds(daily, 5, 20))


@query("v05_block_folds", _blocks(0, 1000, 100))
def v05(spark, sf_dir):
    daily = daily_panel(spark, sf_dir)
    return _block_summary(daily, S.block_folds(daily, 5, 0, 1000, 100))


@query(
    "v06_row_blocks",
    f"""WITH {DAILY}, n AS (SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) AS row, count(*) OVER () AS n FROM daily)
 SELECT ticker, date, row, CAST(CASE WHEN row <= n - 5 * (n // 6) THEN 0 ELSE (row - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 END AS INTEGER) AS block FROM n""",
)
def v06(spark, sf_dir):
    return S.row_blocks(daily_panel(spark, sf_dir).select(*KEY)).select(*KEY, "row", "block")


def _cpcv_sql() -> str:
    parts = []
    for i, combo in enumerate(combinations(range(6), 2)):
        test = " OR ".join(f"(p >= floor({g} * (n / 6)) AND p < floor({g + 1} * (n / 6)))" for g in combo)
        near = " OR ".join(
            f"(p >= greatest(0, floor({g} * (n / 6)) - 5) AND p <= least(n - 1, floor({g + 1} * (n / 6)) - 1 + ceil(n * 0.01::DOUBLE)))"
            for g in combo
        )
        parts.append(f"SELECT date, {i} AS path, CASE WHEN {test} THEN 'test' WHEN NOT ({near}) THEN 'train' END AS role FROM dates")
    return (
        f"WITH {DAILY}, {DATES}, r AS ({' UNION ALL '.join(parts)}) SELECT path, role, count(*) AS n_rows, count(DISTINCT date) AS n_dates"
        " FROM daily JOIN r USING (date) WHERE role IS NOT NULL GROUP BY 1, 2"
    )


@query("v07_cpcv_paths", _cpcv_sql())
def v07(spark, sf_dir):
    daily = daily_panel(spark, sf_dir)
    roles = S.cpcv_paths(daily, purge=5)
    # Rows per date first: the join then carries one row per date, not per bar.
    per_date = daily.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    return (
        roles.join(per_date, "date")
        .groupBy("path", "role")
        .agg(F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_dates"))
    )


@query(
    "v08_purged_holdout",
    f"""WITH {DAILY}, {DATES}, r AS (SELECT ticker, date, CASE WHEN p >= floor(0.8 * n) THEN 'test'
  WHEN p < greatest(0, floor(0.8 * n) - 10) THEN 'train' END AS role FROM daily JOIN dates USING (date))
 SELECT ticker, date, role FROM r WHERE role IS NOT NULL""",
)
def v08(spark, sf_dir):
    daily = daily_panel(spark, sf_dir)
    roles = S.purged_holdout(daily, 0.8, S.purge_positions(90, 9))
    return S.with_roles(daily.select(*KEY), roles).select(*KEY, "role")


@query(
    "v09_positional_split",
    f"""WITH {DAILY} SELECT ticker, date, row_number() OVER (ORDER BY date, ticker) <= floor(count(*) OVER () * 0.5) AS first_part FROM daily""",
)
def v09(spark, sf_dir):
    return S.positional_split(daily_panel(spark, sf_dir).select(*KEY), 0.5).select(*KEY, "first_part")


@query(
    "v10_time_weights",
    f"""WITH {DAILY}, b AS (SELECT min(date) AS lo, max(date) AS hi FROM daily),
 w AS (SELECT ticker, date, exp(-2.0::DOUBLE * (1 - (date - lo) / greatest(hi - lo, 1))) AS raw FROM daily, b)
 SELECT ticker, date, round(raw / avg(raw) OVER (), 6) AS weight FROM w""",
)
def v10(spark, sf_dir):
    return rounded(S.time_weights(daily_panel(spark, sf_dir), 2.0), KEY, 6, ["weight"])


@query(
    "v11_recent_weights",
    f"""WITH {DAILY}, {DATES}, w AS (SELECT ticker, date, CASE WHEN p >= floor(n * (1 - 0.3::DOUBLE)) THEN 2.0 ELSE 1.0 END::DOUBLE AS raw FROM daily JOIN dates USING (date))
 SELECT ticker, date, round(raw / avg(raw) OVER (), 6) AS weight FROM w""",
)
def v11(spark, sf_dir):
    return rounded(S.recent_weights(daily_panel(spark, sf_dir)), KEY, 6, ["weight"])


@query(
    "v12_development_window",
    f"""WITH {WIDE}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM wide))
 SELECT ticker, date FROM wide JOIN d USING (date) WHERE p <= floor(n * 0.25)""",
)
def v12(spark, sf_dir):
    return S.development_window(wide_panel(spark, sf_dir), 0.25).select(*KEY)
