"""Query registry: name -> (Spark builder, optional DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}
PLAN_MODULES = ["q_rules", "q_ingest", "q_validate", "q_metrics", "q_location", "q_features", "q_stream", "q_ml", "q_docs", "q_payloads", "q_documented", "q_joined", "q_switches"]


def register(name: str, sql: str | None = None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, note)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills REGISTRY.
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"agrolens.plans.{mod}")
    return REGISTRY
