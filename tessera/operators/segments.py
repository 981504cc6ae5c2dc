"""Segments: recognised text boxes of a document, their order, lines and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry, text


def parsed_payload(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """``docs`` with ``texts``, ``scores`` and ``boxes`` from an engine's answer as JSON, which has one of two shapes: an object of
    rec_texts, rec_scores and dt_polys, or an array of lines [box, [text, score]], of which those of another length are left
    out. An empty, missing or broken answer gives empty arrays."""
    named = F.from_json(F.col(payload), "rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>")
    listed = lambda v: F.try_variant_get(v, "$", "array<variant>")
    whole = F.try_parse_json(F.col(payload))
    lines = F.filter(F.coalesce(listed(whole), F.array().cast("array<variant>")), lambda line: F.size(listed(line)) == 2)
    part = lambda path, kind: F.transform(lines, lambda line: F.variant_get(line, path, kind))
    either = lambda field, other, kind: F.when(F.col("_named.rec_texts").isNotNull(), F.coalesce(f"_named.{field}", F.array().cast(kind))).otherwise(other)
    out = docs.withColumn("_named", F.when(F.trim(payload).startswith("{"), named))
    return out.withColumns({
        "texts": either("rec_texts", part("$[1][0]", "string"), "array<string>"),
        "scores": either("rec_scores", part("$[1][1]", "double"), "array<double>"),
        "boxes": either("dt_polys", part("$[0]", "array<array<double>>"), "array<array<array<double>>>"),
    }).drop("_named")


def explode_results(docs: DataFrame, key: str = "filename") -> DataFrame:
    """(key, seg_idx, text, ocr_conf, box) from ``texts``, ``scores`` and ``boxes``, cut to the shortest of them."""
    n = F.least(F.size("texts"), F.size("scores"), F.size("boxes"))
    zipped = docs.select(key, n.alias("_n"), F.posexplode(F.arrays_zip("texts", "scores", "boxes")).alias("seg_idx", "_z"))
    return zipped.where("seg_idx < _n").select(key, "seg_idx", F.col("_z.texts").alias("text"), F.col("_z.scores").alias("ocr_conf"), F.col("_z.boxes").alias("box"))


def rank_within(df: DataFrame, key: str, by: list[Column], name: str = "line_rank") -> DataFrame:
    """0-based rank within a document."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*by)) - 1)


def scaled_within(x: Column, key: str) -> Column:
    """(x - min) / (max - min), at least 1, within a document."""
    w = Window.partitionBy(key)
    return (x - F.min(x).over(w)) / F.greatest(F.max(x).over(w) - F.min(x).over(w), F.lit(1))


def keep_first(df: DataFrame, keys: list[Column], by: list[Column]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_nth = 1").drop("_nth")


def line_numbers(ys: Column, gap: float = 0.02) -> Column:
    """Line of each of some sorted heights: a line opens where a height is more than ``gap`` below the height
    that opened the line before, which a lag could not tell."""
    start = F.struct(F.lit(-100.0).alias("anchor"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, y: Column) -> Column:
        opens = y - acc["anchor"] > gap
        line = acc["line"] + opens.cast("int")
        return F.struct(F.when(opens, y).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), F.concat(acc["out"], F.array(line)).alias("out"))

    return F.aggregate(ys, start, step, lambda acc: acc["out"])


def text_features(c: Column) -> dict[str, Column]:
    """The textual features of a segment."""
    return {
        "text_len": F.length(c), "word_count": text.word_count(c), "alpha_ratio": text.alpha_ratio(c), "digit_ratio": text.digit_ratio(c),
        "is_all_caps": text.is_all_caps(c), "has_date_pattern": text.has_date(c), "has_address_kw": text.has_address_word(c),
        "has_state_kw": text.has_state(c), "has_postcode": text.has_postcode(c), "has_bin_binti": text.has_patronymic(c),
    }


def feature_rows(segments: DataFrame, size: DataFrame, key: str = "filename") -> DataFrame:
    """Segments with place, rank and text features; ``size``: (key, width, height). A segment without a box gets
    its number as rank and zeros as place, and is marked as such."""
    placed = segments.join(size, key, "left")
    spatial = F.coalesce(F.size("box") > 0, F.lit(False))
    place = {k: F.when(spatial, v).otherwise(0.0) for k, v in geometry.relative(F.col("box"), F.col("width"), F.col("height")).items()}
    out = placed.withColumns(place).withColumn("is_spatial_dummy", (~spatial).cast("int")).withColumns(text_features(F.col("text")))
    ranked = rank_within(out, key, [F.when(spatial, geometry.center(F.col("box"), "y")), F.col("seg_idx")], "_rank")
    return ranked.withColumn("line_rank", F.when(spatial, F.col("_rank")).otherwise(F.col("seg_idx"))).drop("_rank", "width", "height")
