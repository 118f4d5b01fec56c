"""Registration of queries with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Named sub-queries of the SQL side, in an order in which each may use those before it.
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """``sql`` with the sub-queries it (transitively) names in ``{braces}``."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if "{" + name + "}" in text and name not in needed:
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    whole = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
    for name in CTES:
        whole = whole.replace("{" + name + "}", name)
    return whole


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.strip() if sql.lstrip().upper().startswith("WITH") else with_ctes(sql.strip())
        return f

    return add
