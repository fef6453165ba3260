"""SQL fragments for the checking queries.

They are written independently of the operators: plain windows, recursive
smoothing, full sorts.
"""

from __future__ import annotations

BARS = """
 sum(CAST(floor(l_extendedprice / l_quantity * 10000) AS BIGINT)) / count(*) / 10000 AS open,
 max(CAST(ceil(l_extendedprice / l_quantity * 10000) AS BIGINT)) / 10000.0::DOUBLE AS high,
 min(CAST(floor(l_extendedprice / l_quantity * 10000) AS BIGINT)) / 10000.0::DOUBLE AS low,
 sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)) / 100 AS close,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
"""

DAILY = f"""daily AS MATERIALIZED (
 SELECT s_nationkey AS ticker, CAST(l_shipdate AS DATE) AS date, {BARS}
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

WIDE = f"""wide AS MATERIALIZED (
 SELECT CAST(l_suppkey AS INTEGER) AS ticker, CAST(l_shipdate AS DATE) AS date, {BARS}
 FROM lineitem GROUP BY 1, 2)"""

MARKET = f"""market AS MATERIALIZED (
 SELECT CAST(l_shipdate AS DATE) AS date, {BARS} FROM lineitem GROUP BY 1)"""

SECTOR = "sector AS (SELECT n_nationkey AS ticker, n_regionkey AS sector FROM nation)"

INTRADAY = """bars AS MATERIALIZED (
 SELECT event_type AS ticker, date_trunc('hour', ts) AS ts,
  sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100 AS close,
  max(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE AS high,
  min(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE AS low,
  CAST(count(*) AS DOUBLE) AS volume
 FROM events WHERE value > 0 GROUP BY 1, 2)"""

OVER = "(PARTITION BY ticker ORDER BY date)"


def w(n: int, time: str = "date") -> str:
    return f"(PARTITION BY ticker ORDER BY {time} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ahead(n: int, time: str = "date") -> str:
    return f"(PARTITION BY ticker ORDER BY {time} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def full(agg: str, x: str, n: int, least: int | None = None, time: str = "date") -> str:
    return f"(CASE WHEN count({x}) OVER {w(n, time)} >= {least or n} THEN {agg}({x}) OVER {w(n, time)} END)"


def lag(x: str, n: int = 1, time: str = "date") -> str:
    return f"(lag({x}, {n}) OVER (PARTITION BY ticker ORDER BY {time}))"


def lead(x: str, n: int = 1, time: str = "date") -> str:
    return f"(lead({x}, {n}) OVER (PARTITION BY ticker ORDER BY {time}))"


def clip0(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE greatest({x}, 0.0) END)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name}"


def rank_avg(x: str, part: str) -> str:
    """Tie-averaged rank by counting smaller and equal values."""
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE END)"
    )


def rank_pct(x: str, part: str) -> str:
    return f"({rank_avg(x, part)} / count({x}) OVER (PARTITION BY {part}))"


def ewm(name: str, source: str, items: dict[str, tuple[str, float]], time: str = "date") -> str:
    """CTEs ``name`` = source rows + recursively smoothed columns.

    items: output -> (input column, alpha).
    """
    cols = ", ".join(f"{x} AS i_{o}" for o, (x, _) in items.items())
    start = ", ".join(f"i_{o} AS {o}" for o in items)
    step = ", ".join(
        f"CASE WHEN s.i_{o} IS NULL THEN e.{o} WHEN e.{o} IS NULL THEN s.i_{o}"
        f" ELSE (1.0::DOUBLE - {a!r}::DOUBLE) * e.{o} + {a!r}::DOUBLE * s.i_{o} END AS {o}"
        for o, (_, a) in items.items()
    )
    outs = ", ".join(f"e.{o}" for o in items)
    return f"""
 {name}_n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY {time}) AS rn_{name} FROM {source}),
 {name}_s AS MATERIALIZED (SELECT ticker, rn_{name} AS rn, {cols} FROM {name}_n),
 {name}_e AS (
  SELECT ticker, rn, {start} FROM {name}_s WHERE rn = 1
  UNION ALL
  SELECT s.ticker, s.rn, {step} FROM {name}_e e JOIN {name}_s s ON s.ticker = e.ticker AND s.rn = e.rn + 1),
 {name} AS MATERIALIZED (SELECT n.*, {outs} FROM {name}_n n JOIN {name}_e e ON e.ticker = n.ticker AND e.rn = n.rn_{name})"""


def warm(x: str, n: int, counted: str) -> str:
    """x once ``counted`` has had n non-null values."""
    return (
        f"(CASE WHEN count({counted}) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) >= {n}"
        f" THEN {x} END)"
    )
