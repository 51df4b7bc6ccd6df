"""Query registry: each entry pairs a Spark query with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_CTES: dict[str, tuple[bool, str]] = {}


def cte(name: str, sql: str, recursive: bool = False) -> None:
    """Declare a named SQL block that oracle queries may refer to."""
    _CTES[name] = (recursive, sql.strip())


def _needed(sql: str, found: list[str]) -> list[str]:
    for word in re.findall(r"\b[a-z_][a-z0-9_]*\b", sql):
        if word in _CTES and word not in found:
            found.append(word)
            _needed(_CTES[word][1], found)
    return found


def with_ctes(sql: str) -> str:
    """Prefix a statement with the blocks it needs, in declaration order."""
    names = set(_needed(sql, []))
    blocks = [(n, *_CTES[n]) for n in _CTES if n in names]
    if not blocks:
        return sql.strip()
    head = "WITH RECURSIVE " if any(r for _, r, _ in blocks) else "WITH "
    return head + ",\n".join(f"{n} AS ({text})" for n, _, text in blocks) + "\n" + sql.strip()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL twin where the result can be written in SQL."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql)
        return fn

    return register
