"""Boosted trees and forests over binned columns. Training rows with equal bins, label and weight are one cell with a count,
which is all that trees over bins see of them: a fit costs by its different cells, not by the rows. Every row counts; bins and
cells are made in Spark, trees grown in tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a column, as Spark's trees have by default.
BINS = 32
#: Trees of a forest that one task grows.
BLOCK = 25

#: A tree by its nodes: column (-1: leaf), last bin that goes left, left child (the right one follows), value.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: the number of cuts below it."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def grow(bins: np.ndarray, sums: np.ndarray, depth: int, score: Callable, value: Callable, size: Callable, pick: Callable | None = None) -> Tree:
    """A tree grown level by level. ``sums``: what each row adds to its node; score, value and size work on sums of them, and
    the split of a node is that which raises the score most. ``pick``: (nodes, columns) that may split, of a shape."""
    width, n_sums = bins.shape[1], sums.shape[1]
    node, first = np.zeros(len(bins), dtype=np.int64), 0
    made: list[list[np.ndarray]] = [[], [], [], []]
    for level in range(depth + 1):
        n = int(node.max()) + 1
        total = np.stack([np.bincount(node, sums[:, j], n) for j in range(n_sums)], axis=-1)
        column, cut, left = np.full(n, -1, dtype=np.int16), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int32)
        if level < depth:
            held = np.empty((n, width, BINS, n_sums))
            for i in range(width):
                place = node * BINS + bins[:, i]
                for j in range(n_sums):
                    held[:, i, :, j] = np.bincount(place, sums[:, j], n * BINS).reshape(n, BINS)
            below = held.cumsum(axis=2)[:, :, :-1]
            above = total[:, None, None] - below
            # What rounding leaves of an empty side isn't a row.
            whole, least = score(total), 1e-9 * size(total)
            open_ = (size(below) > least[:, None, None]) & (size(above) > least[:, None, None])
            gain = np.where(open_, score(below) + score(above) - whole[:, None, None], 0.0)
            if pick is not None:
                gain = np.where(pick(n, width)[:, :, None], gain, 0.0)
            gain = gain.reshape(n, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(n), best] > 1e-12 * size(total)
            column[split], cut[split] = best[split] // (BINS - 1), best[split] % (BINS - 1)
            left[split] = first + n + 2 * np.arange(split.sum())
        for parts, part in zip(made, (column, cut, left, value(total)), strict=True):
            parts.append(part)
        keep = column[node] >= 0
        if not keep.any():
            break
        bins, sums, node = bins[keep], sums[keep], node[keep]
        node = left[node] - first - n + (bins[np.arange(len(bins)), column[node]] > cut[node])
        first += n
    return tuple(np.concatenate(parts) for parts in made)


def walked(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The value of the leaf of each row."""
    column, cut, left, value = tree
    node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while len(rows):
        at = node[rows]
        rows, at = rows[column[at] >= 0], at[column[at] >= 0]
        node[rows] = left[at] + (bins[rows, column[at]] > cut[at])
    return value[node]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b > 0)


def boost(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float) -> list[Tree]:
    """Regression trees on the negative gradient of the logistic loss, the first on the labels; as Spark's booster."""
    sign = np.where(y > 0, 1.0, -1.0)
    margin, target, trees = np.zeros(len(y)), sign, []
    for i in range(rounds):
        tree = grow(bins, np.stack([weight, weight * target], axis=1), depth, lambda s: _ratio(s[..., 1] ** 2, s[..., 0]), lambda s: _ratio(s[..., 1], s[..., 0]), lambda s: s[..., 0])
        tree = (*tree[:3], tree[3] * (rate if i else 1.0))
        trees.append(tree)
        margin += walked(tree, bins)
        target = 4 * sign / (1 + np.exp(2 * sign * margin))
    return trees


def bagged(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, count: np.ndarray, classes: int, depth: int, seed: tuple[int, ...]) -> Tree:
    """A tree on rows drawn with replacement: a row is drawn a Poisson number of times, so ``count`` equal ones a
    Poisson number of that mean; each node may split by the root of the columns, rounded up."""
    rng = np.random.default_rng(seed)
    drawn = rng.poisson(count) * weight
    kept = drawn > 0
    sums = np.zeros((len(y), classes))
    sums[np.arange(len(y)), y] = drawn
    few = int(np.ceil(np.sqrt(bins.shape[1])))
    pick = lambda n, width: rng.random((n, width)).argsort(axis=1).argsort(axis=1) < few
    if not kept.any():
        return np.array([-1], np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.zeros((1, classes))
    return grow(bins[kept], sums[kept], depth, lambda s: _ratio((s**2).sum(-1), s.sum(-1)), lambda s: _ratio(s, s.sum(-1, keepdims=True)), lambda s: s.sum(-1), pick)


@dataclass(frozen=True)
class Fitted:
    cuts: list[np.ndarray]
    trees: list[Tree]
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its prediction: the class with the most votes, or whether the margin is above 0."""
        cuts, trees = self.cuts, self.trees

        def predict(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            cells, back = np.unique(binned(np.stack(x.to_list()), cuts), axis=0, return_inverse=True)
            votes = sum(walked(tree, cells) for tree in trees)
            said = votes.argmax(axis=1) if votes.ndim > 1 else votes > 0
            return pd.Series(said[back.ravel()].astype("float64"))

        return df.withColumn("prediction", F.pandas_udf(predict, "double")(vector_to_array(self.features)))


@dataclass(frozen=True)
class Trees:
    """An estimator: ``blocks`` tasks grow the trees of a fit, each by ``make`` of (bins, y, weight, count, block)."""

    label: str
    blocks: int
    make: Callable[..., list[Tree]]
    weight: str = "weight"
    features: str = "features"

    def fit(self, train: DataFrame) -> Fitted:
        make, x = self.make, vector_to_array(self.features)
        width = train.select(F.size(x)).first()[0]
        shares = [i / BINS for i in range(1, BINS)]
        found = train.select(x.alias("x")).agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000) for i in range(width)]).first()
        cuts = [np.unique(np.array(c, dtype=np.float64)) for c in found]

        def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    rows = binned(np.stack(frame.pop("x").to_list()), cuts)
                    yield frame.assign(cell=[row.tobytes() for row in rows])

        def grown(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["cell", "y", "w"])  # the order of rows is no input
            bins = np.frombuffer(b"".join(frame.cell), dtype=np.uint8).reshape(len(frame), width)
            trees = make(bins, frame.y.to_numpy(), frame.w.to_numpy(), frame.n.to_numpy(), key[0])
            return pd.DataFrame({"block": [key[0]], "trees": [pickle.dumps(trees)]})

        rows = train.select(x.alias("x"), F.col(self.label).cast("int").alias("y"), F.col(self.weight).cast("double").alias("w"))
        counted = rows.mapInPandas(cells, "y int, w double, cell binary").groupBy("cell", "y", "w").agg(F.count(F.lit(1)).alias("n"))
        dealt = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))).repartition(2 * self.blocks, "block")
        parts = sorted(dealt.groupBy("block").applyInPandas(grown, "block int, trees binary").collect())
        return Fitted(cuts, [tree for part in parts for tree in pickle.loads(part.trees)], self.features)


def boosted(label: str, rounds: int = 100, depth: int = 5, rate: float = 0.1) -> Trees:
    """Gradient boosting for two classes; a round needs the one before, so one task grows all."""
    return Trees(label, 1, lambda bins, y, w, n, block: boost(bins, y, w * n, rounds, depth, rate))


def forest(label: str, trees: int = 200, depth: int = 10, classes: int = 2, seed: int = 42) -> Trees:
    """A random forest; blocks of trees are grown side by side."""

    def make(bins: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, block: int) -> list[Tree]:
        return [bagged(bins, y, w, n, classes, depth, (seed, i)) for i in range(block * BLOCK, min(trees, (block + 1) * BLOCK))]

    return Trees(label, -(-trees // BLOCK), make)
