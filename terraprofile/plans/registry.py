"""Registry of runnable queries and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terraprofile.plans.fixtures import Inputs, duck_view

_BUILDERS: dict[str, Callable[[Inputs], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the named views as common table expressions."""
    if not views:
        return sql.strip()
    heads = ",\n".join(f"{v} AS ({duck_view(v)})" for v in views)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a builder under ``name`` with its checking SQL, if there is one."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _CHECKS[name] = with_views(sql, views)
        return build

    return register


def _load() -> None:
    from terraprofile.plans import (  # noqa: F401
        queries_batch,
        queries_geometry,
        queries_metrics,
        queries_sources,
        queries_table,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, folder: build(Inputs(spark, folder))

    return {name: bind(build) for name, build in _BUILDERS.items()}


def all_checks() -> dict[str, str]:
    _load()
    return dict(_CHECKS)
