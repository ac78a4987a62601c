"""Registry of queries and of the DuckDB SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verification.bridge import DUCK_VIEWS, Bridge

Builder = Callable[[Bridge], DataFrame]
BUILDERS: dict[str, Builder] = {}
SQL: dict[str, str] = {}
FRAGMENTS: dict[str, str] = dict(DUCK_VIEWS)


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query under the operator's name, with its oracle where SQL can say it."""

    def wrap(build: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = build
        if sql:
            SQL[name] = sql
        return build

    return wrap


def fragment(name: str, sql: str) -> None:
    """Register a named SQL step that several oracles share."""
    if name in FRAGMENTS:
        raise ValueError(f"fragment {name} is registered twice")
    FRAGMENTS[name] = sql


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def assemble(sql: str) -> str:
    """Prefix ``sql`` with the fragments it needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in FRAGMENTS and word not in order:
                visit(FRAGMENTS[word])
                order.append(word)

    visit(sql)
    if not order:
        return sql
    parts = ",\n".join(f"{name} AS ({FRAGMENTS[name]})" for name in order)
    return f"WITH {parts}\nSELECT * FROM ({sql})"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build: Builder) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: build(Bridge(spark, sf_dir))

    return {name: runner(build) for name, build in BUILDERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: assemble(sql) for name, sql in SQL.items()}
