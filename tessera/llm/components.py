"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: So many edges at most are finished in one task; beyond, the rounds go on until nothing changes.
FEW_EDGES = 1_000_000


def _contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of these edges with the smallest node that they join it to."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.get(top, top)) != top:
            top = above
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
    found = [(x, r) for x in up if (r := root(x)) != x]
    yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star round. Minima are aggregated before they are joined back, so a hub's
    edges never meet in one task."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").where("b <> m").select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(df: DataFrame) -> Row:
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()


def _members(now: DataFrame) -> DataFrame:
    members = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def components_by_stars(edges: DataFrame, few: int = 0) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b), by rounds of stars alone, until nothing changes."""
    now = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = _mark(now)
    while seen["n"] > few:
        now = materialize(_stars(now), "edges")
        new = _mark(now)
        if new == seen:
            break
        seen = new
    return _members(now)


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); the component is its smallest id."""
    now = materialize(edges.select("a", "b").where("a <> b").mapInPandas(_contract, "a long, b long"), "edges")
    seen = _mark(now)
    while seen["n"] > few:
        now = materialize(_stars(now), "edges")
        new = _mark(now)
        if new == seen:
            break
        seen = new
    else:
        now = materialize(now.repartition(1).mapInPandas(_contract, "a long, b long"), "edges")
    return _members(now)
