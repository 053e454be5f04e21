"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a Spark query; ``sql`` is its check, over the named shared views."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(uses, sql)
        return fn

    return register


def view(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    _VIEWS[name] = (uses, sql)


def with_views(uses: tuple[str, ...], sql: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{sql}"
