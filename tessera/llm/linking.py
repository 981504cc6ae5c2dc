"""Links between rows of a sparse incidence whose similarity reaches a bound, found without pairing a group.

A row is (rep, n, columns): its id, its size, and the columns of its prefix in one order for all rows, the rarest first.
If 100 |x & y| >= 85 |x | y|, the first n - ceil(0.85 n) + L columns of both rows share at least L entries. Pairs are
tried in rounds: few of each column, linear in its rows, and few more; then those still in different components.
A hot column is split into parts by id: a part has neighbours and a hub of its own, the parts' hubs meet the
column's, and of the pairs left each part holds its rows as one side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize

#: L above; steps of a column's order for each doubling of its count, in the upper byte of the column.
SHARED, STEPS = 2, 6
#: A column or class is hot with more than one in so many of all entries or rows, which bounds their number, and
#: with more rows than a part is to have.
HOT_SHARE, PART_ROWS = 100_000, 1_000
#: How many places apart rows are tried in a further round.
LAGS = 4


def possible(pair: list[Column], percent: int) -> tuple[Column, Column]:
    """For an entry shared at places ``at`` of rows of sizes ``n``: whether both lie in the prefixes that the two
    sizes allow, and how many entries these prefixes must share. A link needs an overlap of o = ceil(percent (n1
    + n2) / (100 + percent)); then prefixes of n - o + L entries share L."""
    n, at, m, to = pair
    overlap = F.ceil((percent * (n + m)) / F.lit(float(100 + percent)) - F.lit(1e-9))
    asked = F.least(F.lit(SHARED), overlap)
    fit = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (at < n - overlap + asked) & (to < m - overlap + asked)
    return fit, asked


def hot(df: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """(keys, n) of the hot among grouped rows: ``HOT_SHARE`` of them at most, which may be broadcast."""
    return df.where((F.col(n) > PART_ROWS) & (F.col(n) * HOT_SHARE > total)).select(*keys, n)


def size_band(n: Column, percent: int) -> Column:
    """Linked rows lie in one band or in neighbouring ones. Bands are a little wider than a link's sizes can differ."""
    return F.floor(F.log(n.cast("double")) / F.lit(-1.001 * math.log(percent / 100))).cast("int")


def gathered(firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(column, part, rep, n, at, prev) of all entries of prefixes but those alone in their column, ``prev`` being
    the neighbour by size within the part; and (column, parts) of the hot columns, the only ones of several parts."""
    entries = firsts.select("rep", "n", F.posexplode("columns").alias("at", "column"))
    # a column's order tells how many rows it has in the whole incidence, so only few need to be counted again
    frequent = F.shiftrightunsigned("column", 56) >= int(math.log2(PART_ROWS) * STEPS)
    total = firsts.agg(F.sum(F.size("columns"))).first()[0] or 0
    counts = entries.where(frequent).groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
    parts = materialize(hot(counts, ["column"], "rows", total).select("column", F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("parts")), "parts")
    part = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("parts")), F.lit(0)).cast("int")
    parted = entries.join(F.broadcast(parts), "column", "left").withColumn("part", part)
    by_size = Window.partitionBy("column", "part").orderBy("n", "rep")
    near = parted.select("column", "part", "parts", "rep", "n", "at", F.lag(F.struct("rep", "n", "at")).over(by_size).alias("prev"), F.lead("rep").over(by_size).alias("after"))
    near = near.where("prev IS NOT NULL OR after IS NOT NULL OR parts IS NOT NULL").drop("parts", "after")
    return materialize(near, "entries"), parts


def tried_pairs(near: DataFrame) -> DataFrame:
    """(rep, n, at, prev, prev_n, prev_at): within each part of a column neighbours by size, and all rows with the
    part's hub; the hubs of a column's parts with that of the column."""
    weight = near.groupBy("rep").agg(F.count(F.lit(1)).alias("weight"))
    weighed = near.select("column", "part", "rep", "n", "at").join(weight, "rep")
    hubs = weighed.groupBy("column", "part").agg(F.max(F.struct("weight", (-F.col("rep")).alias("least"), "n", "at")).alias("hub"))
    as_row = lambda hub: F.struct((-F.col(f"{hub}.least")).alias("rep"), F.col(f"{hub}.n").alias("n"), F.col(f"{hub}.at").alias("at"))
    chained = near.where("prev IS NOT NULL").select("rep", "n", "at", "prev")
    stars = near.select("column", "part", "rep", "n", "at").join(hubs, ["column", "part"]).select("rep", "n", "at", as_row("hub").alias("prev"))
    tops = hubs.groupBy("column").agg(F.max("hub").alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    bridges = hubs.join(tops, "column").select(as_row("hub").alias("own"), as_row("top").alias("prev")).select("own.*", "prev")
    out = chained.union(stars).union(bridges).where("rep <> prev.rep")
    return out.select("rep", "n", "at", F.col("prev.rep").alias("prev"), F.col("prev.n").alias("prev_n"), F.col("prev.at").alias("prev_at"))


def more_pairs(near: DataFrame, merged: DataFrame, salt: int, percent: int) -> DataFrame:
    """(a, b) of rows in different components that follow each other at up to ``LAGS`` places in some part of a column, in an
    order by hash: a number of pairs linear in the rows. Each comes from one column, so they aren't asked to share more."""
    placed = near.join(merged, F.col("rep") == F.col("id"), "left")
    placed = placed.select("column", "part", "rep", "n", "at", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("column", "part").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("column", "part")
    by_hash = Window.partitionBy("column", "part").orderBy(F.xxhash64("rep", F.lit(salt)), "rep")
    row = F.struct("rep", "n", "at", "component")
    others = F.array(*[F.lag(row, k).over(by_hash) for k in range(1, LAGS + 1)])
    followed = placed.join(mixed, ["column", "part"]).withColumn("others", others)
    pairs = followed.select("rep", "n", "at", "component", F.explode("others").alias("o")).where("o.component <> component")
    fit, _ = possible([F.col("n"), F.col("at"), F.col("o.n"), F.col("o.at")], percent)
    return pairs.where(fit).select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).distinct()


def open_pairs(near: DataFrame, merged: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rows in different components that share enough of their prefixes: within a column, rows meet in
    bands of size. Of a hot column, each part holds its own rows as one side, and all as the other."""
    placed = near.join(merged, F.col("rep") == F.col("id"), "left")
    placed = placed.select("column", "part", "at", "rep", "n", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("column").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("column")
    each = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    mixed = mixed.join(F.broadcast(parts), "column", "left").select("column", F.explode(each).alias("part"))
    kept = materialize(placed.join(mixed, ["column", "part"]), "open")
    band = size_band(F.col("n"), percent)
    small = kept.withColumn("band", F.explode(F.array(band, band + 1)))
    large = kept.withColumn("band", band).join(F.broadcast(parts), "column", "left").withColumn("part", F.explode(each))
    x, y = small.alias("x"), large.alias("y")
    fit, asked = possible([F.col(c) for c in ("x.n", "x.at", "y.n", "y.at")], percent)
    on = (F.col("x.column") == F.col("y.column")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.band") == F.col("y.band"))
    on = on & (F.struct("x.n", "x.rep") < F.struct("y.n", "y.rep")) & (F.col("x.component") != F.col("y.component")) & fit
    pairs = x.join(y, on).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), asked.alias("asked"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("asked").alias("asked")).where("shared >= asked").select("a", "b")


def links(firsts: DataFrame, percent: int, confirmed: Callable[[DataFrame], DataFrame], components: Callable[[DataFrame], DataFrame], rounds: int = 0) -> tuple[DataFrame, DataFrame]:
    """(a, b) of confirmed pairs, enough to tell the components of all links; and the components, (id, component).
    ``confirmed`` keeps the pairs (a, b) that are links. ``rounds`` of further linear tries pay where groups of near copies
    lie about the bound, so that many are too far from their hubs; the result is the same."""
    near, parts = gathered(firsts)
    fit, asked = possible([F.col(c) for c in ("n", "at", "prev_n", "prev_at")], percent)
    pairs = tried_pairs(near).where(fit).groupBy(F.least("rep", "prev").alias("a"), F.greatest("rep", "prev").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.min(asked).alias("asked")
    )
    pairs = materialize(pairs.where("shared >= asked").select("a", "b"), "pairs")
    edges = materialize(confirmed(pairs).select("a", "b"), "links")
    merged = components(edges)
    for salt in range(rounds):
        tried = materialize(more_pairs(near, merged, salt, percent).join(pairs, ["a", "b"], "left_anti"), "tried")
        if tried.isEmpty():
            break
        pairs, found = pairs.union(tried), materialize(confirmed(tried).select("a", "b"), "links")
        if found.isEmpty():
            break
        edges = edges.union(found)
        merged = components(edges)
    rest = materialize(open_pairs(near, merged, parts, percent).join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = materialize(confirmed(rest).select("a", "b"), "links")
        if not more.isEmpty():
            edges = edges.union(more)
            merged = components(edges)
    return edges, merged


def given_back(rows: DataFrame, keys: list[str], classes: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` with the column ``component`` of their class, from (keys, copies, component). What a hot class is given
    back is broadcast, so that its rows needn't meet."""
    named = materialize(classes, "named")
    many = hot(named, [*keys, "component"], "copies", n_rows).select(*keys, F.col("component").alias("_hot"))
    few = named.join(F.broadcast(many), keys, "left_anti").select(*keys, "component")
    out = rows.join(F.broadcast(many), keys, "left")
    done = out.where("_hot IS NOT NULL").withColumnRenamed("_hot", "component")
    rest = out.where("_hot IS NULL").drop("_hot").join(few, keys, "left")
    return done.unionByName(rest.select(*done.columns))
