"""Loads every module that registers queries."""

from __future__ import annotations

import importlib

from barloom.plans.registry import ORACLES, QUERIES

MODULES = (
    "q_technicals",
    "q_cleaning",
    "q_labels",
    "q_context",
    "q_splits",
    "q_metrics",
    "q_panels",
    "q_sources",
    "q_models",
    "q_time",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"barloom.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLES)
