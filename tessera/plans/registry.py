"""Queries by name, each with the SQL that checks it, if SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import Tables

Query = Callable[[Tables], DataFrame]
REGISTERED: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(body: Query) -> Query:
        if name in REGISTERED:
            raise ValueError(f"{name} is registered twice")
        REGISTERED[name] = (body, sql)
        return body

    return add


def callable_of(body: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: body(Tables(spark, sf_dir))
