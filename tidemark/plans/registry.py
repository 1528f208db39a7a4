"""Named queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.parsing import named

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function name."""

    def register(run: Run) -> Run:
        QUERIES[name or run.__name__] = Query(run, sql)
        return run

    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, because summation order differs between engines."""
    return df.select([
        F.round(named(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else named(f.name)
        for f in df.schema])
