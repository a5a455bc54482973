"""Named queries over the driver tables, each with DuckDB SQL for the same rows where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from curata.plans import curation, detection, evaluation, flows, manifests, resolutions, reviews, small, streams  # noqa: E402, F401
