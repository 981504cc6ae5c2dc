"""Segment features over arriving files: a stateless projection, so each file is read once and nothing kept."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators.segments import text_features

SCHEMA = "filename string, seg_idx int, text string"


def stream_features(spark: SparkSession, source: str, sink: str, state: str) -> None:
    """Append the text features of segments in files not seen before to ``sink``; ``state`` remembers which were."""
    arriving = spark.readStream.schema(SCHEMA).parquet(source)
    featured = arriving.withColumns(text_features(F.col("text")))
    query = featured.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(sink)
    query.awaitTermination()
