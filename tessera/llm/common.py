"""Pieces that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blank characters between words: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text modulo ``by``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(by))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


#: Tables that this process has written and not cleared.
WRITTEN: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete the tables that operators of this process have written. Frames that read them are of no use then."""
    while WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: its lineage is cut, so a lost
    executor costs no recomputation, and every reader sees the same rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, rank: str, total: str | None = None) -> DataFrame:
    """Add the 0-based rank of each row within ``keys``, ordered by ``salt`` and then by ``order``.

    A hot key is spread over its salts: rows are ranked within (key, salt), and the number of rows
    under smaller salts, from a pre-aggregated table, is added. ``total``: also add the key's row count.
    """
    parts = [F.col(k) for k in keys]
    df = df.withColumn("_salt", salt)
    counts = df.groupBy(*parts, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    by_salt = Window.partitionBy(*parts)
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_salt").alias("_ksalt"),
        (F.sum("_n").over(by_salt.orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_under"),
        F.sum("_n").over(by_salt).alias("_total"),
    )
    local = F.row_number().over(Window.partitionBy(*parts, "_salt").orderBy(*order))
    on = F.col("_salt").eqNullSafe(F.col("_ksalt"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = df.withColumn("_local", local).join(offsets, on)
    out = out.withColumn(rank, F.col("_under") + F.col("_local") - 1)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_salt", "_ksalt", "_under", "_total", "_local", *[f"_k{i}" for i in range(len(keys))])


def release() -> None:
    """Hand memory that this worker has freed back to the system: workers live on, and would keep their peak."""
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only there is such a call in glibc
        ctypes.CDLL(None).malloc_trim(0)


def chunks(frames: Iterator[pd.DataFrame], column: str, most: int = 500_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches so that a chunk holds about ``most`` characters, or one longer row."""
    for frame in frames:
        start, held = 0, 0
        for i, text in enumerate(frame[column]):
            held += len(text) if text else 0
            if held >= most:
                yield frame.iloc[start : i + 1]
                start, held = i + 1, 0
        if start < len(frame):
            yield frame.iloc[start:]
    release()


#: Stands for a null id where rows pass through pandas, which would turn whole columns of ids into fractions.
NO_ID = -(1 << 63)


def whole_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def real_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def small_batches(docs: DataFrame, rows: int = 1000) -> DataFrame:
    """``docs``, whose texts are long, to be handed to Python in batches of fewer rows than the default. A number
    of rows that the session set itself stays."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs


def steady(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, if its rows come straight from files, and so have a place there; else a materialized copy."""
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    nodes = [re.sub(r"^[\s+:*()\d-]*", "", line).split(" ")[0] for line in plan.splitlines() if line.strip()]
    plain = nodes.count("FileScan") == 1 and set(nodes) <= {"FileScan", "Project", "ColumnarToRow"}
    return docs if plain else materialize(docs, name)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, BLANKS))).cast("long")
