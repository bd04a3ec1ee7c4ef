"""Where query modules put their DataFrame builders and SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and the SQL for the same rows if there is one."""

    def add(build):
        key = name or build.__name__
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return add
