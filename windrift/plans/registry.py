"""All registered queries (spark, sf_dir) -> DataFrame, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    """Register a function under its name; oracle is the same query in DuckDB's SQL, or None where SQL can't say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def load() -> None:
    from windrift.plans import aggregation, domain, files, joining, outlines, outputs, projection, regridding, sequence, streams, tables  # noqa: F401


load()
