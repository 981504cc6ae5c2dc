"""Tf-idf of the character grams of ``learning.char_grams`` by their counts: a text is an array of code points, its grams are
numbers, counted by sorting, and no list of a text's grams is made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import learning

#: A gram is the number of its one or two code points.
SHIFT, PAIR = 21, 1 << 42
#: Bytes of text that are counted at once.
SLICE = 2 << 20


def spaced(text: Column) -> Column:
    """The lower-case words with one blank before each and one at the end; empty without words."""
    words = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise("")


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and the text of each."""
    texts = column.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return points, np.repeat(np.arange(len(texts)), [len(x) for x in texts])


def counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, count) of ``spaced`` texts, sorted by text and gram. The words between two blanks share neither:
    each has its own, so that of n words has 2 n blanks."""
    points, owner = _points(column)
    letters, back = np.unique(points, return_inverse=True)
    k = len(letters)
    pairs = owner[1:] == owner[:-1]
    # Within a text, letters come first, then pairs of them: in the order of their grams.
    base = owner * (k + k * k)
    keys, counts = np.unique(np.concatenate([base + back, (base[1:] + k + back[:-1] * k + back[1:])[pairs]]), return_counts=True)
    text, rest = np.divmod(keys, max(1, k + k * k))
    single = rest < k
    first, second = np.divmod(np.where(single, 0, rest - k), max(1, k))
    codes = np.where(single, letters[np.where(single, rest, 0)], PAIR | letters[first] << SHIFT | letters[second]) if k else rest
    counts = np.where(codes == ord(" "), 2 * (counts - 1), counts)
    return text, codes, counts


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts pass a bound; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch[column])), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def totals(df: DataFrame, column: str, group: str) -> DataFrame:
    """(group, gram, n, texts): how often each gram occurs in the group's texts, and in how many of them."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "text"):
            text, codes, counts = counted(batch["text"])
            groups, back = np.unique(np.asarray(batch["group"]), return_inverse=True)
            grams, place = np.unique(codes, return_inverse=True)
            cell = back[text] * len(grams) + place
            n, texts = np.bincount(cell, counts, len(groups) * len(grams)), np.bincount(cell, minlength=len(groups) * len(grams))
            at = np.flatnonzero(texts)
            owner, gram = np.divmod(at, max(1, len(grams)))
            yield pa.RecordBatch.from_arrays([pa.array(groups[owner]), pa.array(grams[gram]), pa.array(n[at].astype(np.int64)), pa.array(texts[at].astype(np.int64))], ["group", "gram", "n", "texts"])

    parts = df.select(F.col(group).cast("long").alias("group"), spaced(F.col(column)).alias("text")).mapInArrow(summed, "group long, gram long, n long, texts long")
    return parts.groupBy("group", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def known_counts(df: DataFrame, column: str, grams: np.ndarray) -> DataFrame:
    """``df`` with ``at``, the places in the sorted ``grams`` of those that the text has, and ``n``, their counts, in place of
    the text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, column):
            text, codes, counts = counted(batch[column])
            at = np.searchsorted(grams, codes)
            known = grams[np.minimum(at, len(grams) - 1)] == codes if len(grams) else np.zeros(len(codes), dtype=bool)
            lists = [_lists(text[known], batch.num_rows, v[known].astype(np.int32)) for v in (at, counts)]
            rest = batch.drop_columns([column])
            yield pa.RecordBatch.from_arrays([*rest.columns, *lists], [*rest.schema.names, "at", "n"])

    rest = df.drop(column)
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in rest.dtypes), "at array<int>, n array<int>"])
    return df.select(*rest.columns, spaced(F.col(column)).alias(column)).mapInArrow(found, schema)


def weighed(df: DataFrame, grams: np.ndarray, kept: np.ndarray, idf: np.ndarray, out: str = "features") -> DataFrame:
    """``df`` of ``known_counts`` with length-1 vectors of counts times ``idf`` over the ``kept`` of the grams."""
    width = len(kept)
    place = np.full(len(grams) + 1, width)  # what isn't kept goes to a last column, which is cut
    place[np.searchsorted(grams, kept)] = np.arange(width)
    scale = np.append(idf, 0.0)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                at, n = part["at"], part["n"]
                to = place[np.asarray(at.flatten())]
                vectors = np.zeros((part.num_rows, width + 1))
                vectors[np.repeat(np.arange(part.num_rows), np.asarray(at.value_lengths())), to] = np.asarray(n.flatten()) * scale[to]
                length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
                vectors = np.ascontiguousarray((vectors / np.where(length > 0, length, 1.0))[:, :width])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width), pa.array(vectors.ravel()))
                rest = part.drop_columns(["at", "n"])
                yield pa.RecordBatch.from_arrays([*rest.columns, lists], [*rest.schema.names, "x"])

    rest = df.drop("at", "n")
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in rest.dtypes), "x array<double>"])
    return df.select(*rest.columns, "at", "n").mapInArrow(dense, schema).withColumn(out, array_to_vector("x")).drop("x")


class FoldGrams:
    """Tf-idf of each fold's training rows: the ``size`` commonest grams (of equal ones the smaller code) of all other
    folds, and their document frequencies there. Texts are read twice: for the totals, and for the counts of grams that any
    fold keeps, at most ``size`` a fold."""

    def __init__(self, df: DataFrame, column: str, folds: list[int], size: int) -> None:
        rows = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
        # A gram's rank in a fold is by its sum over the others; only those within ``size`` of one are collected.
        found = totals(df, column, "fold").cache()
        self.kept, self.idf = {}, {}
        try:
            for fold in folds:
                best = found.where(F.col("group") != fold).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
                top = sorted((r["gram"], r["texts"]) for r in best.orderBy(F.desc("n"), "gram").limit(size).collect())
                n = sum(c for f, c in rows.items() if f != fold)
                self.kept[fold] = np.array([g for g, _ in top], dtype=np.int64)
                self.idf[fold] = np.log((1.0 + n) / (1.0 + np.array([c for _, c in top], dtype=np.float64))) + 1.0
        finally:
            found.unpersist()
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *self.kept.values()]))
        self.counts = known_counts(df, column, self.grams)

    def features(self, df: DataFrame, fold: int) -> DataFrame:
        return weighed(df, self.grams, self.kept[fold], self.idf[fold])


def held_out(df: DataFrame, column: str, label: str, make: Callable[[str], object], folds: list[int], size: int) -> DataFrame:
    """As ``learning.held_out``, over tf-idf of the grams of a column; two folds are fitted at a time, so that the vectors of
    few are held at once."""
    held = FoldGrams(df, column, folds, size)
    counts = held.counts.cache()
    tasks = max(1, counts.count() // learning.TASK_ROWS)

    def one(fold: int) -> DataFrame:
        train, test = counts.where(F.col("fold") != fold), counts.where(F.col("fold") == fold)
        train = learning.balanced_weight(train, label).select(label, "weight", "at", "n").coalesce(tasks)
        return make(label).fit(held.features(train, fold)).transform(held.features(test, fold))

    with ThreadPoolExecutor(2) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, folds))
