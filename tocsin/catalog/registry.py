"""Registered queries and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .site import Site, site

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, tuple[str, str, str | None]] = {}
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: str, sql: str) -> None:
    """A named common table expression for checking SQL."""
    PARTS[name] = (tuple(needs.split()), sql)


def with_parts(needs: str, sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0]:
                visit(n)
            order.append(name)

    for n in needs.split():
        visit(n)
    if not order:
        return sql
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + sql


def query(name: str, needs: str = "", sql: str | None = None, before: str | None = None):
    """Register ``fn(site) -> DataFrame`` and, where SQL can say it, its check.
    With ``before`` the check reads only the events before that moment."""

    def put(fn: Callable[[Site], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(site(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = (needs, sql, before)
        return fn

    return put


def oracles() -> dict[str, str]:
    out = {}
    for name, (needs, sql, before) in CHECKS.items():
        text = with_parts(needs, sql)
        if before:
            text = re.sub(r"\bFROM events\b", f"FROM (SELECT * FROM events WHERE ts < TIMESTAMP '{before}') events", text)
        out[name] = text
    return out
