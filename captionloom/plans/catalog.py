"""All registered queries and their SQL."""

from __future__ import annotations

from captionloom.plans import features, prepare, storage, tokens

MODULES = [prepare, features, tokens, storage]


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
