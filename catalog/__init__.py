"""Registered queries over the driver tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.adapters import Tables
from catalog.casts import typed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under `name`; doubles on both sides are rounded to 6 places by `tidy`."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(Tables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = typed(name, sql)
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places (no negative zero) and widen integers, so both engines print the same values."""
    from pyspark.sql import functions as F, types as T

    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        out.append(col.alias(field.name))
    return df.select(*out)


def load() -> None:
    from catalog import registry  # noqa: F401
