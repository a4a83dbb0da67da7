"""Names, plans and oracle SQL of the queries outside of the corpus subpackage."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with the SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
