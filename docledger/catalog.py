"""Queries of the document operators and their SQL equivalents, by name."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, oracle: str | None = None):
    """Decorator: adds ``fn(spark, sf_dir)`` under ``name``."""

    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


def queries() -> dict:
    from docledger import queryset, queryset2, queryset3  # noqa: F401  registers on import

    return QUERIES


def oracle_sql() -> dict:
    queries()
    return ORACLES
