"""Reading and writing tables: schemas are declared, never inferred."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import strip


@dataclass(frozen=True)
class Tables:
    """The Parquet tables of a folder, as attributes."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def repaired(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of a CSV file whose lines were quoted as a whole: blank lines go, outer quotes are unwrapped, doubled
    quotes made single; short rows are padded with null, long ones cut."""
    bare = strip(F.col(column))
    whole = bare.rlike('^".*"$') & ~bare.rlike('^"[^"]*"(,|$)')
    unwrapped = F.when(whole, F.replace(F.substring(bare, 2, 1 << 30).substr(F.lit(1), F.length(bare) - 2), F.lit('""'), F.lit('"'))).otherwise(bare)
    parsed = lines.where(bare != "").select(F.from_csv(unwrapped, schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*")


def select_available(df: DataFrame, names: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """The named columns that there are, and given defaults for those that aren't."""
    defaults = defaults or {}
    return df.select(*[F.col(n) if n in df.columns else defaults[n].alias(n) for n in names if n in df.columns or n in defaults])


def missing_keys(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a result cache doesn't hold yet."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def stale(files: DataFrame, cache: DataFrame, key: str, changed: str, cached: str) -> DataFrame:
    """Files that the cache lacks, or holds from before their last change."""
    held = cache.select(key, F.col(cached).alias("_cached"))
    return files.join(held, key, "left").where(F.col("_cached").isNull() | (F.col(changed) > F.col("_cached"))).drop("_cached")


def merged(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with fresh rows in place of old ones of the same key."""
    return cache.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in the order of ``by``, without bringing them together: they are sorted into ranges and
    written, each is numbered within its range, and the sizes of the ranges, one row each, are summed up."""
    path = scratch(df.sparkSession, "sorted")
    place = F.monotonically_increasing_id()
    df.orderBy(*by).withColumns({"_range": F.shiftright(place, 33), name: place.bitwiseAND((1 << 33) - 1)}).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    return held.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, the same in each run, by a hash of the key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images by file name; what can't be decoded is left out, so that a left join shows it as missing."""
    images = spark.read.format("image").option("dropInvalid", True).load(path)
    return images.select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"), "image")


def write_images(images: DataFrame, path: str) -> None:
    """Write (filename, image) rows as bitmap files, one each, into a folder that all executors share; a null image gives a
    file that can't be decoded. A task that is run again writes the same files."""
    if "://" in path.replace("file://", "", 1):
        raise ValueError("images are written to a folder of a file system, not to a remote store")
    folder = path.removeprefix("file://").removeprefix("file:")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for name, h, w, channels, data in frame.itertuples(index=False):
                part = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with open(part, "wb") as file:
                    file.write(bitmap(h, w, channels, data) if data is not None else b"no image")
                os.replace(part, f"{folder}/{name}")
            yield frame[["filename"]]

    columns = images.select("filename", *[F.coalesce(f"image.{c}", F.lit(0)).alias(c) for c in ("height", "width", "nChannels")], "image.data")
    columns.mapInPandas(write, "filename string").write.format("noop").mode("overwrite").save()


def bitmap(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A picture of one or three channels, blue first, as an uncompressed bitmap file of 24 bits a pixel."""
    if channels == 1:
        data = b"".join(bytes([v]) * 3 for v in data)
    rows = [data[i * width * 3 : (i + 1) * width * 3].ljust(-(-width * 3 // 4) * 4, b"\0") for i in range(height)]
    body = b"".join(reversed(rows))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def probe_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, modificationTime, length) of the files below a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "modificationTime", "length")
