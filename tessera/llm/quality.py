"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader
updates and applied as a sparse dot product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.ftrl import Features, Model, TrainConfig, score, train, verdicts

FEATURES = Features(bits=18, skips=(1,), shapes=True, fold=False)
CONFIG = TrainConfig(max_rows=8_000, epochs=3, alpha=0.1, l1=0.5, l2=1.0)
THRESHOLD = 0.3


def fit_quality(docs: DataFrame, labels: DataFrame, learnable: Column | None = None) -> Model:
    """Learn ``labels.quality`` (0 or 1) from at most ``CONFIG.max_rows`` labelled texts."""
    return train(docs, labels, "quality", F.lit(True) if learnable is None else learnable, FEATURES, CONFIG)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row. Null and empty texts score by the bias alone; very long texts are read
    in whole, and a feature counts once however often they hold it; repeated rows are scored each and alike; a score that
    ties with the threshold is predicted 1; an empty table gives no rows; other columns are ignored."""
    return score(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the model doesn't reject. The decision is taken
    in place: texts are not shuffled. Null and empty texts are judged by the bias alone, which keeps them where
    most labelled rows are good; very long texts are read in whole; equal rows share a verdict; a score that ties with the
    threshold stays; an empty table gives no rows."""
    return verdicts(docs, model, THRESHOLD)
