"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of a source, shuffled by a seeded hash, get ranks; sorting all rows by fractional rank interleaves the
sources in proportion, and cutting that order into equal counts makes every shard match the mixture. Law:
``rows`` (counts at most one apart). Ranks are taken in small groups whose sizes are summed beforehand, so
neither a hot source nor the whole order ever meets in one task; texts never leave the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import salted_rank

SHARDS, SEED, GROUPS = 16, 43, 4096


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and the crc32 of no bytes, 0; a null source is a source; rows with equal ids are
    ordered by text crc32 and size; an empty table gives no rows; other columns are ignored."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("_h"),
    )
    order = [F.col(c) for c in ("_h", "doc_id", "text_crc32", "size")]
    ranked = salted_rank(rows, ["source"], order, F.substring("_h", 1, 2), "_rank", "_of")
    placed = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_of"))
    placed = salted_rank(placed, [], [F.col("_f"), *order, F.col("source")], F.floor(F.col("_f") * GROUPS), "_at", "_all")
    return placed.withColumn("shard", F.expr(f"(_at * {shards}) div _all").cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_at") - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def crc32_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320, by its rule."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    return table


def crc32_sql(blob: str) -> str:
    """DuckDB expression for the unsigned crc32 of a blob."""
    byte = f"list_transform(range(octet_length({blob})), lambda i: ('0x' || substr(hex({blob}), 2 * i + 1, 2))::BIGINT)"
    step = f"lambda a, b: xor(a >> 8, {crc32_table()}[(xor(a, b) & 255) + 1]::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), {step}), 4294967295::BIGINT)"


def shard_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    return f"""
WITH d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, encode(coalesce(text, '')) AS b,
             md5('{seed}:' || doc_id) AS h FROM documents),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM d),
k AS (SELECT *, row_number() OVER (ORDER BY f, h, doc_id) - 1 AS k, count(*) OVER () AS n FROM f)
SELECT doc_id, size, {crc32_sql("b")} AS text_crc32, 'rows' AS law, (k * {shards} // n)::INT AS shard,
       (k - ((k * {shards} // n) * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM k
"""
