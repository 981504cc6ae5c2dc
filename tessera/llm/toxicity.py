"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams. Per-coordinate rates
learn rare words fast; L1 leaves some thousand weights, small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ftrl import Features, Model, TrainConfig, score, train

FEATURES = Features(bits=20, skips=(1, 2), shapes=False, fold=True)
CONFIG = TrainConfig(max_rows=20_000, epochs=8, alpha=2.0, l1=4.0, l2=0.0)
THRESHOLD = 0.7


def fit_toxicity(docs: DataFrame, labels: DataFrame, learnable: Column | None = None) -> Model:
    """Learn ``labels.toxic`` (0 or 1) from at most ``CONFIG.max_rows`` labelled texts."""
    return train(docs, labels, "toxic", F.lit(True) if learnable is None else learnable, FEATURES, CONFIG)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row. Null and empty texts score by the bias alone; very long texts are read
    in whole, and a feature counts once however often they hold it; repeated rows are scored each and alike; a score that
    ties with the threshold is predicted 1; an empty table gives no rows; other columns are ignored."""
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
