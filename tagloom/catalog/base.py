"""Registry of runnable queries and of the SQL text each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_TWINS: dict[str, tuple[str, tuple[str, ...]]] = {}
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            _TWINS[name] = (sql, uses)
        return fn

    return register


def part(name: str, body: str, uses: tuple[str, ...] = ()) -> None:
    """A named common table expression other statements can build on."""
    _PARTS[name] = (uses, body)


def compose(body: str, uses: tuple[str, ...]) -> str:
    """The statement with the expressions it uses; a body that starts with a comma adds expressions, recursive ones too."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in _PARTS[name][0]:
            visit(parent)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_PARTS[name][1].strip()})" for name in ordered)
    recursive = "RECURSIVE " if body.lstrip().startswith(",") else ""
    return f"WITH {recursive}{ctes}\n{body.strip()}"


def sql_texts() -> dict[str, str]:
    return {name: compose(body, uses) for name, (body, uses) in _TWINS.items()}
