"""Every query by name, and the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with SQL for the same rows where there is some."""

    def add(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
