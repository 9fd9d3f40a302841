"""Where plans register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    from vidspark.plans import features, frames, manifest, metrics, models, quality, reports, scalars, sources, splits  # noqa: F401
    return QUERIES, ORACLES
