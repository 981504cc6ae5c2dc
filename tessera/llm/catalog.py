"""Queries opN_<name> over the whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tessera.llm.common import remainder, table
from tessera.llm.language import score_language, score_sql
from tessera.llm.mixing import mix, mix_sql
from tessera.llm.packing import pack
from tessera.llm.quality import fit_quality, score_quality
from tessera.llm.rules import judge
from tessera.llm.sharding import crc32_sql, shard, shard_sql
from tessera.llm.spotsigs import fingerprints
from tessera.llm.substrings import digest_sql, digests
from tessera.llm.toxicity import fit_toxicity, score_toxicity


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document, learnt from labelled rows outside the held-out fold. Edge cases: ``score_quality``."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from labelled rows outside the held-out fold. Edge cases: ``score_toxicity``."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that 100-byte strings from earlier on cover, and what is left, for every document. Edge cases: ``digests``."""
    return digests(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document. Edge cases: ``mix``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and near copies. Edge cases: ``fingerprints``."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document's shingle set. Edge cases: ``jaccard.join``."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. Edge cases: ``shard``."""
    return shard(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole document under a model of those outside the held-out fold. Edge cases: ``score_language``."""
    out = score_language(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)
    # sums of logarithms depend on their order in the last digits
    scores = [F.round(c, 6).alias(c) for c in ("base_score", "score")]
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *scores)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences. Edge cases: ``pack``."""
    return pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict on every whole document. Edge cases: ``judge``."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("llr")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_toxicity, op3_suffix_array_dedup, op4_mixing, op5_fingerprints, op6_ngram_jaccard_join, op7_sharding, op8_lm_scoring, op9_packing, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    scored = score_sql(f"{crc32_sql('encode(doc_id::VARCHAR)')} % 7 <> 2")
    return {
        "op3_suffix_array_dedup": digest_sql(),
        "op4_mixing": mix_sql(),
        "op6_ngram_jaccard_join": jaccard.join_sql(),
        "op7_sharding": shard_sql(),
        "op8_lm_scoring": f"SELECT doc_id, NOT train AS held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM ({scored})",
    }
