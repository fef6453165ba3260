"""Long trailing windows in logarithmic time.

A sliding frame of n rows costs n updates per row.  Here the aggregates of 4,
16, 64, ... rows are built from each other with ``lag`` and a window of any
length is put together from a few of them, so 756 rows cost about 25 lags.  All steps
share one partitioning and one sort.

A result is NULL unless all n values are present (min_periods = n).
Deviations merge means and squared deviations pairwise, which keeps full
precision and gives exactly 0 on a constant series.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.functions.expr import Axis

BASE = 4


@dataclass(frozen=True)
class Roll:
    """kind: avg, sum, std, std_pop, max or min."""

    kind: str
    source: str
    n: int

    @property
    def state(self) -> str:
        return {"std": "dev", "std_pop": "dev", "avg": "dev", "sum": "dev"}.get(self.kind, self.kind)


def _level(n: int) -> int:
    level = 0
    while BASE ** (level + 1) <= n:
        level += 1
    return level


def _tiles(n: int) -> list[tuple[int, int]]:
    """Disjoint (level, offset) pieces that add up to n rows."""
    out, used = [], 0
    for level in range(_level(n), -1, -1):
        while n - used >= BASE**level:
            out.append((level, used))
            used += BASE**level
    return out


def _cover(n: int) -> list[tuple[int, int]]:
    """Pieces of the largest size that fit, the last one overlapping."""
    level = _level(n)
    size = BASE**level
    return [(level, k) for k in range(0, n - size, size)] + [(level, n - size)]


def _extreme(kind: str, parts: list[str]) -> str:
    if len(parts) == 1:
        return parts[0]
    whole = " AND ".join(f"{p} IS NOT NULL" for p in parts)
    return f"CASE WHEN {whole} THEN {'greatest' if kind == 'max' else 'least'}({', '.join(parts)}) END"


def _total(parts: Iterable[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def with_rolling(df: DataFrame, ax: Axis, specs: dict[str, Roll]) -> DataFrame:
    """Add one column per spec.

    Expressions are SQL text, one call per step: a wide feature set would
    otherwise spend seconds building columns one by one.
    """
    keep = [c for c in df.columns if c not in specs]
    top: dict[tuple[str, str], int] = defaultdict(int)
    spread: set[str] = set()  # sources that need squared deviations
    for s in specs.values():
        top[(s.state, s.source)] = max(top[(s.state, s.source)], _level(s.n))
        if s.kind.startswith("std"):
            spread.add(s.source)
    ids = {key: i for i, key in enumerate(top)}
    keys = ", ".join(f"`{k}`" for k in ax.keys)
    over = f"OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY `{ax.time}`)"

    def name(key: tuple[str, str], level: int, part: str = "m") -> str:
        return f"__r{ids[key]}_{level}{part}"

    def add(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
        return frame.selectExpr("*", *[f"{text} AS `{new}`" for new, text in columns.items()]) if columns else frame

    def lagged(frame: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
        return add(frame, {new: f"lag({old}, {k}) {over}" if k else old for new, (old, k) in columns.items()})

    deviates = {key for key in top if key[0] == "dev" and key[1] in spread}
    start = {}
    for key in top:
        x = f"CAST(`{key[1]}` AS DOUBLE)"
        start[name(key, 0)] = x
        if key in deviates:
            start[name(key, 0, "q")] = f"CASE WHEN {x} IS NOT NULL THEN 0D END"
    staged = add(df, start)

    for level in range(1, max(top.values(), default=0) + 1):
        size = BASE ** (level - 1)
        want = [key for key, t in top.items() if t >= level]
        have = [(key, p) for key in want for p in ("m", "q") if p == "m" or key in deviates]
        part = lambda key, p, j: f"{name(key, level - 1, p)}_{j}"  # noqa: B023, E731
        lags = {part(key, p, j): (name(key, level - 1, p), j * size) for key, p in have for j in range(BASE)}
        staged = lagged(staged, lags)
        means, spreads = {}, {}
        for key in want:
            m = [part(key, "m", j) for j in range(BASE)]
            mean = name(key, level)
            means[mean] = f"{_total(m)} / {BASE}D" if key[0] == "dev" else _extreme(key[0], m)
            if key in deviates:
                q = [part(key, "q", j) for j in range(BASE)]
                gaps = _total(f"({x} - {mean}) * ({x} - {mean})" for x in m)
                spreads[name(key, level, "q")] = f"{_total(q)} + {size}D * {gaps}"
        staged = add(add(staged, means), spreads).drop(*lags)

    lags = {}
    for out, s in specs.items():
        key = (s.state, s.source)
        for j, (level, k) in enumerate(_tiles(s.n) if s.state == "dev" else _cover(s.n)):
            lags[f"__{out}_{j}m"] = (name(key, level), k)
            if s.kind.startswith("std"):
                lags[f"__{out}_{j}q"] = (name(key, level, "q"), k)
    staged = lagged(staged, lags)
    means, final = {}, {}
    for out, s in specs.items():
        if s.state != "dev":
            final[out] = _extreme(s.kind, [f"__{out}_{j}m" for j in range(len(_cover(s.n)))])
            continue
        sizes = [BASE**level for level, _ in _tiles(s.n)]
        mean = f"__{out}_mean"
        means[mean] = _total(f"{w}D * __{out}_{j}m" for j, w in enumerate(sizes)) + f" / {s.n}D"
        if s.kind == "sum":
            final[out] = f"{mean} * {s.n}D"
        elif s.kind == "avg":
            final[out] = mean
        else:
            q = _total(
                f"__{out}_{j}q + {w}D * (__{out}_{j}m - {mean}) * (__{out}_{j}m - {mean})" for j, w in enumerate(sizes)
            )
            final[out] = f"sqrt({q} / {s.n - 1 if s.kind == 'std' else s.n}D)"
    return add(staged, means).selectExpr(*[f"`{c}`" for c in keep], *[f"{t} AS `{o}`" for o, t in final.items()])
