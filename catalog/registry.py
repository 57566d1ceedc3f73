"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from catalog.views import BASE, VIEWS, Db, sql_text

QUERIES: dict[str, Callable[[Db], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _views_used(sql: str) -> list[str]:
    """Views the text mentions, directly or through other views, in definition order."""
    used, stack = set(), [sql]
    while stack:
        text = stack.pop()
        for name in VIEWS:
            if name not in used and _mentions(text, name):
                used.add(name)
                stack.append(sql_text(name))
    return [n for n in VIEWS if n in used]


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?i)\b(?:from|join)\s+{name}\b|,\s*{name}\s+\w+\s*(?:where|$)", text) is not None


def with_views(sql: str) -> str:
    ctes = ",\n".join(f"{n} AS (\n{sql_text(n)}\n)" for n in _views_used(sql))
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(db) -> DataFrame`` under a name, with the DuckDB text it must agree with."""
    def keep(fn: Callable[[Db], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return keep
