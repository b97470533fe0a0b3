"""Named queries: each is a Spark plan over the driver tables plus, where the
semantics are SQL-expressible, an independent DuckDB oracle text.

Queries run over whole tables. Doubles are rounded (6 places) in both the
Spark result and the oracle so the value hashes compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    oracle: str | None
    ids: str  # SURVEY §2 ids covered


REGISTRY: dict[str, Query] = {}


def register(name: str, ids: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, oracle, ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills the registry
    from . import q_interactions, q_io, q_retrieval, q_sequences, q_text  # noqa: F401
    return REGISTRY
