"""The registry of queries: each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Registers a query with its SQL; None where a test compares it with brute force instead."""

    def register(f):
        REGISTERED[f.__name__] = (f, sql)
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r6_all(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns rounded."""
    return df.withColumns({c: r6(F.col(c)) for c in names})
