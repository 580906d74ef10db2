"""Registry of named queries: a Spark builder plus, where SQL can express
it, an equivalent DuckDB query over the raw driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    survey_id: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


_REGISTRY: dict[str, Entry] = {}


def register(name: str, survey_id: str, sql: str | None = None):
    def deco(fn):
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Entry(name, survey_id, fn, sql.strip() if sql else None)
        return fn
    return deco


def _load_all() -> None:
    # Importing the modules registers their entries.
    from verdigris.plans import (cat_timeseries, cat_validate, cat_carbon,  # noqa: F401
                                 cat_tables, cat_features, cat_monitor, cat_ledger,
                                 cat_sources, cat_forecast, cat_streaming)


def entries() -> dict[str, Entry]:
    _load_all()
    return dict(_REGISTRY)
