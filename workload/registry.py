"""Name -> query and name -> SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function; without SQL only its rows are checked."""
    def keep(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """A double cut to digits both engines agree on."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def joined(c: Column | str) -> Column:
    """A string array as one string."""
    return F.array_join(c, "|")
