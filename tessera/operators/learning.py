"""Scaling, text vectors, folds and model comparison."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, CountVectorizer, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.evaluation import confusion, fold_scores


def minmax_scaled(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns scaled to 0..1 under new names; nulls count as 0, a constant column gives 0."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(0))
    bounds = df.agg(*[F.min(filled(c)).alias(f"_lo_{c}") for c in names], *[F.max(filled(c)).alias(f"_hi_{c}") for c in names])
    joined = df.join(F.broadcast(bounds))
    scaled = {new: F.coalesce(F.try_divide(filled(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)) for c, new in names.items()}
    return joined.withColumns(scaled).drop(*bounds.columns)


def standardized(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns less their mean over their population deviation under new names; nulls count as 0."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    fit = df.agg(*[F.avg(filled(c)).alias(f"_m_{c}") for c in names], *[F.stddev_pop(filled(c)).alias(f"_s_{c}") for c in names])
    scale = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    joined = df.join(F.broadcast(fit))
    return joined.withColumns({new: (filled(c) - F.col(f"_m_{c}")) / scale(c) for c, new in names.items()}).drop(*fit.columns)


def principal(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Add pc1..pck of the standardized columns; each component's largest loading is positive."""
    z = standardized(df, {c: f"_z_{c}" for c in columns})
    held = VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="_v").transform(z)
    loadings = PCA(k=k, inputCol="_v", outputCol="_p").fit(held).pc.toArray()
    out = held
    for i in range(k):
        column = loadings[:, i]
        sign = 1.0 if column[abs(column).argmax()] > 0 else -1.0
        out = out.withColumn(f"pc{i + 1}", reduce(lambda a, b: a + b, [F.col(f"_z_{c}") * float(sign * w) for c, w in zip(columns, column, strict=True)]))
    return out.drop("_v", *[f"_z_{c}" for c in columns])


def balanced_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (k n_c): the weight that balances the classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(counts), label).join(F.broadcast(total)).withColumn(name, F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def char_grams(text: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """Character n-grams of blank-padded words."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda n: F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))))
    return F.concat(*[grams(n) for n in sizes])


def tfidf_fit(train: DataFrame, tokens: str, size: int, out: str = "features") -> Callable[[DataFrame], DataFrame]:
    """A function that adds length-1 vectors of counts times ln((1 + n) / (1 + df)) + 1 over the ``size`` commonest
    tokens of ``train``; all it knows comes from there."""
    counted = CountVectorizer(inputCol=tokens, outputCol="_tf", vocabSize=size).fit(train)
    held = counted.transform(train)
    width = len(counted.vocabulary)
    present = held.select(F.posexplode(vector_to_array("_tf")).alias("i", "x")).where("x > 0")
    n = held.count()
    known = dict.fromkeys(range(width), 0) | {r["i"]: r["c"] for r in present.groupBy("i").agg(F.count(F.lit(1)).alias("c")).collect()}
    idf = F.array(*[F.log(F.lit((1.0 + n) / (1.0 + known[i]))) + 1.0 for i in range(width)])

    def add(df: DataFrame) -> DataFrame:
        weighed = counted.transform(df).withColumn("_w", array_to_vector(F.zip_with(vector_to_array("_tf"), idf, lambda a, b: a * b)))
        return Normalizer(inputCol="_w", outputCol=out).transform(weighed).drop("_tf", "_w")

    return add


def tfidf(df: DataFrame, tokens: str, size: int, out: str = "features") -> DataFrame:
    """``tfidf_fit`` of a frame to itself."""
    return tfidf_fit(df, tokens, size, out)(df)


def word_tokens(df: DataFrame, column: str, out: str = "tokens") -> DataFrame:
    return RegexTokenizer(inputCol=column, outputCol=out, pattern=r"\b\w\w+\b", gaps=False).transform(df)


def logistic(label: str) -> LogisticRegression:
    return LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)


def forest(label: str, trees: int = 200, depth: int = 10) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=42)


def boosted(label: str, rounds: int = 100, depth: int = 5, classes: int = 2) -> GBTClassifier | OneVsRest:
    """Gradient boosting; for more than two classes one booster against the rest for each."""
    booster = GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=42)
    return booster if classes == 2 else OneVsRest(classifier=booster, labelCol=label, weightCol="weight")


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.na.fill(0, columns))


#: So many rows that are fitted at least make a task of their own.
TASK_ROWS = 10_000

Prepare = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def _split(df: DataFrame, label: str, fold: int, prepare: Prepare | None) -> tuple[DataFrame, DataFrame]:
    """The weighed training rows and the test rows of a fold; ``prepare`` sees the training rows alone."""
    train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
    if prepare:
        add = prepare(train)
        train, test = add(train), add(test)
    return balanced_weight(train, label), test


def held_out(df: DataFrame, label: str, make: Callable[[str], object], folds: list[int], prepare: Prepare | None = None, together: bool = True) -> DataFrame:
    """The rows of all ``folds``, each with the prediction of a model fitted on the other folds. Folds are fitted side by
    side, each on rows brought together in one task unless it is said otherwise."""
    held = df.cache()
    held.count()

    def one(fold: int) -> DataFrame:
        train, test = _split(held, label, fold, prepare)
        return make(label).fit(train.coalesce(1) if together else train).transform(test)

    with ThreadPoolExecutor(len(folds)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, folds))


def out_of_fold(df: DataFrame, label: str, models: dict[str, Callable[[str], object]], folds: list[int]) -> DataFrame:
    """(fold, model, macro_f1, weighted_f1, train_time_sec, infer_time_sec), each model fitted on the other folds. The times
    are the driver's, without that for making the features; folds run one after the other, so that they don't hold each
    other up."""
    held = df.select(label, "fold", "features").cache()
    rows = []
    try:
        tasks = max(1, held.count() // TASK_ROWS)
        for k in folds:
            train, test = _split(held, label, k, None)
            for name, make in models.items():
                began = time.perf_counter()
                fitted = make(label).fit(train.coalesce(tasks))
                trained = time.perf_counter()
                cells = confusion(fitted.transform(test).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))).collect()
                inferred = time.perf_counter()
                rows += [(k, name, r["y"], r["yhat"], r["n"], trained - began, inferred - trained) for r in cells]
    finally:
        held.unpersist()
    cells = df.sparkSession.createDataFrame(rows, "fold int, model string, y int, yhat int, n long, train_time_sec double, infer_time_sec double")
    return fold_scores(cells, ["fold", "model", "train_time_sec", "infer_time_sec"]).select("fold", "model", "macro_f1", "weighted_f1", "train_time_sec", "infer_time_sec")


def group_folds(df: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """(group, fold 1..k): groups stay whole, classes are spread evenly. Groups are counted in Spark; their sizes,
    one row for each distinct vector of class counts, are dealt out greedily on the driver, the most uneven
    first, and groups of one vector take turns by rank."""
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    counts = df.groupBy(group).agg(*[F.sum((F.col(label) == c).cast("int")).alias(f"_c{i}") for i, c in enumerate(classes)])
    names = [f"_c{i}" for i in range(len(classes))]
    kinds = sorted(counts.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (-max(r[:-1]), -sum(r[:-1]), r[:-1]))
    held = [[0] * len(classes) for _ in range(k)]
    turns = []
    for kind in kinds:
        each, n = list(kind[:-1]), kind["n"]
        first = min(range(k), key=lambda f: (sum(h * e for h, e in zip(held[f], each, strict=True)), sum(held[f]), f))
        for f in range(k):
            share = n // k + (1 if (f - first) % k < n % k else 0)
            held[f] = [h + share * e for h, e in zip(held[f], each, strict=True)]
        turns.append((*each, first))
    start = df.sparkSession.createDataFrame(turns, ", ".join([*(f"{c} bigint" for c in names), "_first int"]))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(group), group)) - 1
    return counts.join(F.broadcast(start), names).select(group, ((F.col("_first") + rank) % k + 1).cast("int").alias("fold"))
