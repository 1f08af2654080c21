"""Collects the registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return put
