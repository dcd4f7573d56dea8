"""Registry of runnable queries and of the SQL that checks them."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from drawmark.sources.views import view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(uses: tuple[str, ...], body: str) -> str:
    """Checking SQL: the named input views, then ``body`` (a SELECT, or ', name AS (...) SELECT')."""
    # decimal literals as doubles, the way the DataFrame code computes; quoted text is left alone
    parts = body.split("'")
    body = "'".join(p if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for i, p in enumerate(parts))
    heads = ", ".join(f"{name} AS ({view_sql(name)})" for name in uses)
    if not heads:
        return body
    return f"WITH RECURSIVE {heads} {body}"


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(uses, sql)
        return fn
    return add
