"""The registered queries of the library, and SQL for those that SQL can express."""

from __future__ import annotations

from . import registry
from .queries import causality, extras, foundation, models, series, testing  # noqa: F401  they register what they hold
from .registry import Query


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
