"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tuneprep.plans.tables import Tables, sql_with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, longs: tuple[str, ...] = ()):
    """Register a ``Tables -> DataFrame`` function under its name, with its SQL text.

    ``longs`` names whole-number columns that the SQL engine would type as 32-bit.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            text = sql_with_views(sql)
            if longs:
                casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in longs)
                text = f"SELECT * REPLACE ({casts}) FROM ({text}) AS result"
            ORACLES[fn.__name__] = text
        return fn

    return wrap
