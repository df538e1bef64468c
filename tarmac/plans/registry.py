"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}
CATALOGS = ["catalog_aggregates", "catalog_cleaning", "catalog_graph", "catalog_rows", "catalog_revenue_weather", "catalog_scheduling", "catalog_ml", "catalog_intents", "catalog_streaming"]


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # importing the catalog modules fills REGISTRY
    import importlib

    for mod in CATALOGS:
        importlib.import_module(f"tarmac.plans.{mod}")

    return REGISTRY
