"""Named queries: a function of (spark, sf_dir), and the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def wall_clock(df: DataFrame) -> DataFrame:
    """df with its instants as times of the session's zone, as the tables hold them."""
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: wall_clock(f(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
