"""Checked queries over tables derived from the given test data."""

from __future__ import annotations

import importlib

MODULES = ("market", "research", "trading", "evidence", "landing", "designs", "report", "market_rules")


def all_cases():
    from workload.cases import CASES

    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return CASES
