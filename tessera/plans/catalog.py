"""All registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its equivalent SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from tessera.plans import decks, design, exchange, fields, located, model, prints, relational, spaces, stages  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(SQL)
