"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, mixing, packing, substrings
from tessera.llm.common import materialize, table
from tessera.llm.quality import fit_quality, keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, rejects go. Null and empty texts are judged by
    the bias; very long ones in whole; equal rows alike; a table without labelled rows scores 0.5, which keeps all."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, linked at five-word shingles and a similarity of 0.8, the document with
    the smallest id stays. Texts without words, null texts and null ids stay; rows of one id stay or go together; columns
    of any name pass through; an empty table gives no rows."""
    return jaccard.keep_first(docs, width=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that also start earlier are cut; a document that this leaves without any
    word goes. Documents that lost nothing stay, blank or null or not; of equal strings that of the smallest id and place
    stays; rows of one id are one document; an empty table gives no rows."""
    return substrings.dedup(docs, keep_emptied=False)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix of sources takes, one for each copy. A null source is one of its own; rows without words have
    copies like others of their source, but none in a source without any; an empty table gives no rows."""
    return mixing.take(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. Null and empty texts are the end id alone; very long
    ones are cut; equal rows are packed each; an empty table gives no rows."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: Models, hashes and tokenizers are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
