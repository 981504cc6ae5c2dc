"""Hashed n-gram logistic regression with follow-the-regularised-leader updates.

Training runs on a bounded sample of labelled rows (``TrainConfig.max_rows``, chosen by a hash of the
id, so that reruns agree), in one task that streams it in a fixed order: FTRL is a sequential method.
Everything that grows with the corpus (featurising and scoring) is a projection of each partition with
broadcast weights, whose size is bounded by ``2 ** bits``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, real_ids, small_batches, whole_ids

TOKEN = re.compile(r"\w+|[^\w\s]+")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Hashes(dict):
    """Token to 32-bit hash, with its shape above that: 0 other, 1 lower, 2 capitalised, 3 upper, 4 digits.
    ``room`` bounds the cache of a worker."""

    room = 150_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.room:
            self.clear()
        shape = 1 if token.islower() else 3 if token.isupper() and len(token) > 1 else 2 if token.istitle() else 4 if token.isdigit() else 0
        self[token] = value = crc32(token.encode("utf-8", "surrogatepass")) | shape << 32
        return value


@dataclass(frozen=True)
class Features:
    """Which n-grams are hashed. ``skips``: distances of word pairs, 1 being the bigram. ``shapes``: also
    n-grams of word shapes (case, digits, symbol runs, repetition). ``fold``: lower-case words."""

    bits: int = 18
    skips: tuple[int, ...] = (1,)
    shapes: bool = False
    fold: bool = True

    def of(self, texts: list[str], cache: Hashes, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs of some texts, ordered by row; ``wanted``: by feature, which to give."""
        lists = [TOKEN.findall(t.lower() if self.fold else t) if t else [] for t in texts]
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = [t for x in lists for t in x]
        known = np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat))
        words = known & np.uint64(0xFFFFFFFF)
        found = self._grams(words, row, 0, self.skips)
        if self.shapes:
            found += self._grams(self._shapes(known >> np.uint64(32), words, row), row, 2, (1, 2))
        if wanted is not None:
            found = [(r[keep], b[keep]) for r, b in found for keep in [wanted[b.view(np.int64)]]]
        rows = np.concatenate([r for r, _ in found])
        bucket = np.concatenate([b for _, b in found])
        keys = np.unique((rows.astype(np.uint64) << np.uint64(self.bits)) | bucket)
        return (keys >> np.uint64(self.bits)).astype(np.int64), (keys & np.uint64((1 << self.bits) - 1)).astype(np.int32)

    def _grams(self, h: np.ndarray, row: np.ndarray, kind: int, skips: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        high = np.uint64(64 - self.bits)
        out = [(row, ((h + np.uint64(kind + 1)) * ODD[0]) >> high)]
        for skip in skips:
            together = row[skip:] == row[: len(row) - skip]
            pair = (h[: len(h) - skip] * ODD[1]) ^ (h[skip:] * ODD[2]) ^ np.uint64((skip + 8 * kind) * int(ODD[3]) % 2**64)
            out.append((row[skip:][together], ((pair * ODD[0]) >> high)[together]))
        return out

    @staticmethod
    def _shapes(kind: np.ndarray, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Shape of each token; symbol runs keep their hash; 8 is added to a token equal to the one before."""
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        return np.where(kind == 0, words, kind) + np.where(same, np.uint64(8), np.uint64(0))


@dataclass(frozen=True)
class TrainConfig:
    """``max_rows`` bounds the labelled sample; ``alpha``, ``beta``, ``l1``, ``l2`` are FTRL-proximal's.
    A feature's value is 1 in a text that has it."""

    max_rows: int = 8_000
    epochs: int = 3
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.1


@dataclass(frozen=True)
class Model:
    """Sparse weights; the bias is kept apart."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    features: Features
    config: TrainConfig

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.features.bits, np.float32)
        w[self.index] = self.weight
        return w

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        w, cache = self.dense(), Hashes()
        held = w != 0

        def score(texts: list[str]) -> np.ndarray:
            row, feature = self.features.of(texts, cache, held)
            z = np.bincount(row, weights=w[feature], minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(z + self.bias, -35, 35)))

        return score


def _learn(examples: list[tuple[np.ndarray, int]], bits: int, c: TrainConfig) -> tuple[np.ndarray, np.ndarray, float]:
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = 0.0, 0.0
    for _ in range(c.epochs):
        for features, label in examples:
            zi, ni = z[features], n[features]
            w = np.where(np.abs(zi) <= c.l1, 0.0, -(zi - np.sign(zi) * c.l1) / ((c.beta + np.sqrt(ni)) / c.alpha + c.l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            z[features] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / c.alpha * w
            n[features] = ni + g * g
            bias_n += g * g
            bias -= c.alpha * g / (c.beta + np.sqrt(bias_n))
    w = np.where(np.abs(z) <= c.l1, 0.0, -(z - np.sign(z) * c.l1) / ((c.beta + np.sqrt(n)) / c.alpha + c.l2))
    index = np.flatnonzero(w)
    return index, w[index], bias


def train(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, features: Features, config: TrainConfig) -> Model:
    """Fit on the labelled rows for which ``learnable`` holds. Rows with a null label or id, and texts that
    are null, teach nothing; several labels of an id count as their maximum; several texts of an id are
    all used. Without examples of any kind the model scores 0.5 everywhere."""
    chosen = (
        labels.where(learnable & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(config.max_rows)
    )
    texts = small_batches(docs).select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")

    def featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = Hashes()
        for part in chunks(frames, "text"):
            row, feature = features.of(list(part["text"]), cache)
            cuts = np.searchsorted(row, np.arange(1, len(part)))
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "y": part["_y"].to_numpy(), "feature": np.split(feature, cuts)})

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        examples = [(np.asarray(f), int(y)) for frame in frames for f, y in zip(frame["feature"], frame["y"], strict=True)]
        index, weight, bias = _learn(examples, features.bits, config)
        yield pd.DataFrame({"index": [index.astype(np.int32)], "weight": [weight], "bias": [bias]})

    rows = texts.mapInPandas(featurise, "doc_id long, y int, feature array<int>")
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(29)), "doc_id", F.size("feature"))
    got = one.mapInPandas(fit, "index array<int>, weight array<double>, bias double").collect()
    index, weight, bias = (got[0]["index"], got[0]["weight"], got[0]["bias"]) if got else ([], [], 0.0)
    return Model(np.asarray(index, np.int32), np.asarray(weight, np.float32), bias, features, config)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """(doc_id, ``column``) of every row of ``docs``, null and empty texts included: those score by the bias."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = sent.value.scorer()
        for part in chunks(frames, "text"):
            yield pd.DataFrame({"doc_id": part["doc_id"], column: scorer(list(part["text"]))})

    rows = whole_ids(small_batches(docs).select("doc_id", "text"))
    return real_ids(rows.mapInPandas(apply, f"doc_id long, {column} double"))


def verdicts(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = sent.value.scorer()
        for series in frames:
            parts = [scorer(list(p["text"])) for p in chunks(iter([series.to_frame("text")]), "text")]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return small_batches(docs).where(scored(F.col("text")) >= F.lit(threshold))
