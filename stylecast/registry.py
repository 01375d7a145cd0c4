"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with DuckDB SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            from .plans.fixtures import sql_with

            ORACLES[name] = sql_with(oracle)
        return f

    return register


for _module in ("keys", "saved", "dates", "joins", "analysis", "festival", "panel", "model", "planning", "similarity", "report", "evaluation", "design", "rankings", "seasons", "products", "lots", "streams"):
    importlib.import_module(f".plans.{_module}", __package__)
