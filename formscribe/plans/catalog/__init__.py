"""Registered queries with their checking SQL. Importing the package fills `QUERIES`."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register `fn(spark, sf_dir)`; `sql` is the equivalent text for the checking database."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from formscribe.plans.catalog import (  # noqa: F401
        scalars,
        keys,
        profiles,
        rules,
        validation,
        reviews,
        reports,
        vectors,
        clusters,
        hierarchy,
        neighbours,
        training,
        approximate,
        streams,
        storage,
    )
