"""All registered queries of the trajectory operators, with SQL for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "speed_sigma_bands"
MODULES = ("scalars", "gating", "joins", "statistics", "sequences", "kernels", "vehicles", "details", "volume", "texts", "estimates", "georeference", "inertial_motion", "alignment", "attitudes")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tracelake.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
