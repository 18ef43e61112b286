"""Queries and oracle SQL of the library's own operators, gathered from the plan modules."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import sievework.plans as plans


def _modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("plan_"))
    return [importlib.import_module(f"{plans.__name__}.{n}") for n in names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
