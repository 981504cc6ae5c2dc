"""Mixing sources to target weights by systematic sampling.

Targets: sources, by code point with null last, weigh 5, 2, 1, repeating; they share ``share`` of all sizes,
a source's target stops at ``cap`` times its size and the excess is shared again by weight, which is water
filling to one level. Sampling: a source's rows, ordered by size, each expect target/size copies; prefix sums
of these expectations plus one offset per source give a copy for each integer boundary crossed. Rows ordered
by size keep the words taken near the target. A hot source is ranked in many groups (``salted_rank``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize, n_words, salted_rank
from tessera.llm.counting import FILE, NTH, numbered

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, 41
#: Names that no column of the input should have.
PLACE, COPY = (FILE, NTH), "__tessera_copy"
#: Hexadecimal digits of a hash that make a number from 0 to 1 without rounding.
DIGITS = 13


def unit(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows with (source, size). Only the level of the water, a number, is
    worked out round by round on the driver; every round is an aggregate over the sources."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = salted_rank(
        sources, [], [F.col("source")], F.concat(F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.lit("0")), F.substring(F.coalesce("source", F.lit("")), 1, 8)), "_at"
    )
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    known = by_name.select("source", "source_size", weigh.alias("_w"), (cap * F.col("source_size")).alias("_cap"))
    known = materialize(known, "sources")
    level = -1.0
    while True:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        got = known.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("capped"),
            F.sum(F.when(~full, F.col("_w"))).alias("w"),
        ).first()
        if not got["w"]:
            break
        higher = (share * got["all"] - got["capped"]) / got["w"]
        if higher <= level:
            break
        level = higher
    return known.select("source", "source_size", F.when(full, F.col("_cap")).otherwise(F.col("_w") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (words), source, source_size, target, copies, taken.

    Null or empty texts have size 0 and take no words; a null source is a source of its own, the last; a
    source without words has target 0; equal rows count each; an empty table gives no rows; other columns of
    ``docs`` are ignored, but those of ``PLACE``, which are kept."""
    extra = [c for c in docs.columns if c in PLACE]
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *extra), "sizes")
    goal = targets(sized)
    digits = F.col("size").cast("string")
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    salt = F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(digits, 1, 2), F.substring(hashed, 1, 1))
    ranked = salted_rank(sized.withColumn("_h", hashed), ["source"], [F.col("size"), F.col("_h"), F.col("doc_id")], salt, "_rank")
    goal = goal.withColumnRenamed("source", "_source")
    out = ranked.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat_ws(":", F.lit(str(seed)), F.lit("source"), F.coalesce("source", F.lit(""))))
    crossed = F.floor((F.col("_rank") + 1) * F.col("_each") + F.col("_u")) - F.floor(F.col("_rank") * F.col("_each") + F.col("_u"))
    out = out.withColumn("_each", each).withColumn("_u", offset).withColumn("copies", crossed.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *extra)


def take(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``; a row of two copies comes twice. Null and empty
    texts have size 0 and copies like any row of their source, but none in a source without words; equal rows
    count each; an empty table gives no rows."""
    placed = numbered(docs, "mixing")
    chosen = mix(placed, seed).where("copies > 0").select(*PLACE, "copies")
    joined = placed.alias("n").join(chosen.alias("c"), [F.col(f"n.{p}") == F.col(f"c.{p}") for p in PLACE])
    repeated = joined.withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col("c.copies").cast("int"))))
    return repeated.select(*[F.col(f"n.`{c}`") for c in docs.columns])


def mix_sql(seed: int = SEED) -> str:
    """DuckDB SQL for (doc_id, size, source_size, target, taken) of ``documents``."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
             md5('{seed}:' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, (CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, {CAP}::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, sum(cap) OVER o - cap AS below, (SELECT sum(w) FROM w) - (sum(w) OVER o - w) AS rest FROM w
        WINDOW o AS (ORDER BY cap / w, nth ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max(({SHARE}::DOUBLE * (SELECT sum(source_size) FROM s) - below) / rest) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN cap <= w * level THEN cap ELSE w * level END AS target,
             ('0x' || substr(md5('{seed}:source:' || coalesce(source, '')), 1, {DIGITS}))::BIGINT / {float(16**DIGITS)!r}::DOUBLE AS u FROM w, l),
k AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
             row_number() OVER (PARTITION BY d.source ORDER BY lpad(length(size::VARCHAR)::VARCHAR, 2, '0') || substr(size::VARCHAR, 1, 2) || substr(h, 1, 1), size, h, doc_id) - 1 AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor((k + 1) * each + u) - floor(k * each + u))::BIGINT * size AS taken FROM k
"""
