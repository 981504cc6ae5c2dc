"""Registry of the engine's own queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import aggregates, evaluations, extractions, features, models, pictures, relations, strings  # noqa: F401
from tessera.plans.registry import REGISTERED, callable_of
from tessera.sources.tables import Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy token overlap of consecutive turns, by role."""
    pairs = REGISTERED["f9_token_overlap"][0](Tables(spark, sf_dir))
    return pairs.groupBy("role").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("overlap").alias("mean_overlap")).orderBy("role")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: callable_of(body) for name, (body, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
