"""Weak labels of segments, their audit, and the calibration of a confidence threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, distance, geometry
from tessera.functions.text import strip_field_number


def weak_scores(seg: Column, name: Column, birth: Column, address: Column) -> dict[str, Column]:
    return {
        "name": distance.token_overlap(strip_field_number(seg), name),
        "birth_date": dates.birth_date_evidence(seg, birth),
        "address": F.when(F.coalesce(address, F.lit("")) == "", 0.0).otherwise(distance.token_overlap(seg, address)),
    }


def weak_label(name: Column, birth: Column, address: Column, threshold: float = 0.5) -> Column:
    """The best score's field, name before birth_date before address on ties; other below the threshold."""
    best = F.greatest(name, birth, address)
    field = F.when(name == best, "name").when(birth == best, "birth_date").otherwise("address")
    return F.when(best >= threshold, field).otherwise("other")


def threshold(df: DataFrame, confidence: str, measure: str, good: Column, default: float = 0.85) -> DataFrame:
    """(threshold): the lower edge of the first bin of confidence whose median measure is good."""
    return binned_median(df, confidence, measure).agg(F.coalesce(F.min(F.when(good, F.col("bin"))), F.lit(default)).alias("threshold"))


def binned_median(df: DataFrame, confidence: str, measure: str) -> DataFrame:
    """(bin, median) of the bins that have rows."""
    binned = df.withColumn("bin", geometry.confidence_bin(F.col(confidence))).where("bin IS NOT NULL")
    return binned.groupBy("bin").agg(F.median(measure).alias("median"))
