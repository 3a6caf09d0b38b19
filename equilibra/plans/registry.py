"""Registry of named queries: a Spark builder and, where SQL can express it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: str


QUERIES: dict[str, Query] = {}


def register(name: str, ops: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    import importlib
    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")
    return QUERIES


MODULES = ("fairness_queries", "summary_queries", "text_queries", "fold_queries", "embedding_queries", "mitigation_queries", "proxy_queries", "model_queries", "experiment_queries",
           "source_queries", "phrase_queries")
