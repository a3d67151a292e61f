"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from brinefield.registry.projections import Inputs
from brinefield.runtime import tune

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register ``fn(Inputs) -> DataFrame`` under ``name`` with an optional SQL twin."""
    def keep(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, sf_dir):
            return fn(Inputs(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (sql, ctes)
        return fn
    return keep
