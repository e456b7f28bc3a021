"""Registry of named queries: (spark, sf_dir) -> DataFrame, plus DuckDB SQL twins.

Query modules call ``register``; ``load`` imports them all once.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

MODULES = [
    "tessera.plans.q_sources",
    "tessera.plans.q_profile",
    "tessera.plans.q_frame",
    "tessera.plans.q_analytics",
    "tessera.plans.q_anomaly",
    "tessera.plans.q_forecast",
    "tessera.plans.q_ml",
    "tessera.plans.q_monitoring",
    "tessera.plans.q_text",
    "tessera.plans.q_streaming",
    "tessera.plans.q_reports",
]


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_loaded = False


def load() -> None:
    global _loaded
    if _loaded:
        return
    for m in MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as exc:   # module not written yet
            if exc.name != m:
                raise
    _loaded = True


def queries() -> dict[str, QueryFn]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLE)
