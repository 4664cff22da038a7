"""Queries of the engine's operators over the standard tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a (spark, sf_dir) query under a name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    """Query modules register themselves on import."""
    import importlib
    import pkgutil

    import quillon.plans as plans

    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__) if x.name.startswith("q_")):
        importlib.import_module(f"quillon.plans.{m}")


_load()
