"""The registry of queries, and SQL pieces that several of them use."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its DuckDB SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def closure_sql(edges: str) -> str:
    return f"WITH RECURSIVE e AS ({edges}), c(source, target, distance) AS (SELECT source, target, 1 FROM e UNION SELECT c.source, e.target, c.distance + 1 FROM c JOIN e ON c.target = e.source), closed AS (SELECT source, target, CAST(min(distance) AS BIGINT) AS distance FROM c GROUP BY 1, 2)"


def up_sql(edges: str) -> str:
    return closure_sql(edges) + ", up AS (SELECT source, target FROM closed UNION SELECT source, source FROM e UNION SELECT target, target FROM e)"
