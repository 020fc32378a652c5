"""All registered queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Adds a query, and the SQL that gives the same rows where there is one."""

    def add(query: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = query
        if oracle is not None:
            _oracles[name] = _nudged(oracle)
        return query

    return add


def _nudged(sql: str) -> str:
    """Rounding to six digits as ``functions.scores.r6`` does it."""
    return re.sub(r", 6\)", " + 1e-9, 6)", sql)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)


def _load() -> None:
    """Imports the modules that register queries."""
    from orefall.plans import chunks, evaluation, extras, pipes, replies, repo, retrieval, sources, state, streams, tables  # noqa: F401
