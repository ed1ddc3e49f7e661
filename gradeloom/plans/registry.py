"""Registered queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .oracle import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register a query; ``views`` are the adapter views its SQL refers to."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return wrap


def load() -> None:
    from . import dedup_queries  # noqa: F401
    from . import evaluation_queries  # noqa: F401
    from . import fewshot_queries  # noqa: F401
    from . import path_queries  # noqa: F401
    from . import prompt_queries  # noqa: F401
    from . import review_queries  # noqa: F401
    from . import source_queries  # noqa: F401
    from . import streaming_queries  # noqa: F401
