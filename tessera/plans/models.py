"""Fitted transforms, folds and model comparison. SQL can't express these: tests check ranges and invariants."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import alpha_ratio, digit_ratio, rule_field, word_count
from tessera.operators import grams, learning, trees
from tessera.operators.evaluation import class_report, confusion, fold_scores, macro_f1
from tessera.plans.registry import query
from tessera.sources.tables import Tables

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("l1_pca")
def l1(t: Tables) -> DataFrame:
    return learning.principal(t.lineitem.select("l_orderkey", *NUMBERS), NUMBERS).select("l_orderkey", "pc1", "pc2")


ZS = "z AS (SELECT l_orderkey, l_quantity, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem)"


@query("l1_pca_pair", f"""WITH {ZS}, c AS (SELECT avg(a * b) AS c FROM z) SELECT l_orderkey, l_quantity, round(abs(a + b) / sqrt(2), 6) AS along, round(abs(a - b) / sqrt(2), 6) AS across FROM z""")
def l1_pair(t: Tables) -> DataFrame:
    """Of two columns, the components are their sum and their difference; the sign of a component that loads both alike
    is a matter of rounding."""
    out = learning.principal(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    rising = out.agg(F.corr("l_quantity", "l_extendedprice") > 0).first()[0]
    along, across = ("pc1", "pc2") if rising else ("pc2", "pc1")
    return out.select("l_orderkey", "l_quantity", F.round(F.abs(along), 6).alias("along"), F.round(F.abs(across), 6).alias("across"))


@query("a15_variances", f"WITH {ZS}, c AS (SELECT abs(avg(a * b)) AS c FROM z) SELECT round(1 + c, 6) AS first, round(1 - c, 6) AS second FROM c")
def a15(t: Tables) -> DataFrame:
    """Eigenvalues of the covariance of two standardized columns: the variances along the components."""
    out = learning.principal(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return out.agg(F.round(F.var_pop("pc1"), 6).alias("first"), F.round(F.var_pop("pc2"), 6).alias("second"))


@query("l3_group_folds")
def l3(t: Tables) -> DataFrame:
    return learning.group_folds(t.orders.withColumn("late", (F.col("o_orderstatus") == "F").cast("int")), "o_custkey", "late")


@query("l3_leak_check", "SELECT 0::BIGINT AS leaked, count(DISTINCT o_custkey) AS groups FROM orders")
def l3_leaks(t: Tables) -> DataFrame:
    folds = l3(t)
    held = t.orders.join(folds, "o_custkey").groupBy("o_custkey").agg(F.count_distinct("fold").alias("n"))
    return held.agg(F.count_if(F.col("n") > 1).alias("leaked"), F.count(F.lit(1)).alias("groups"))


def _labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"), (F.col("doc_id") % 5).alias("fold"))


#: The folds of ``_labelled``.
FOLDS = [0, 1, 2, 3, 4]


def _guessed(held: DataFrame, make: Callable[[str], object], *prepare: learning.Prepare, **how: bool) -> DataFrame:
    """(doc_id, fold, y, yhat) of every row, out of fold."""
    guessed = learning.held_out(held, "label", make, FOLDS, *prepare, **how)
    return guessed.select("doc_id", "fold", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))


def _tfidf(size: int) -> learning.Prepare:
    return lambda train: learning.tfidf_fit(train, "tokens", size)


@query("l4_word_tfidf_logistic")
def l4(t: Tables) -> DataFrame:
    return _guessed(learning.word_tokens(_labelled(t), "text"), learning.logistic, _tfidf(300)).select("doc_id", "y", "yhat")


@query("l4_tfidf_weights", """WITH w AS (SELECT n_nationkey AS id, unnest(string_split(lower(n_name || ' ' || r_name || ' ' || r_name), ' ')) AS token FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT id, token, count(*) AS tf FROM w WHERE length(token) > 1 GROUP BY 1, 2),
i AS (SELECT token, ln((1 + (SELECT count(*) FROM nation)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM c GROUP BY 1),
v AS (SELECT id, token, tf * idf AS x FROM c JOIN i USING (token)) SELECT id, round(sum(x) / sqrt(sum(x * x)), 6) AS total, round(max(x) / sqrt(sum(x * x)), 6) AS highest, count(*) AS n FROM v GROUP BY 1""")
def l4_weights(t: Tables) -> DataFrame:
    """The weights themselves, where the vocabulary holds all tokens: their sum, the highest and their number."""
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.concat_ws(" ", "n_name", "r_name", "r_name").alias("text"))
    held = learning.tfidf(learning.word_tokens(names, "text"), "tokens", 300).withColumn("v", F.filter(vector_to_array("features"), lambda x: x > 0))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return held.select("id", F.round(total, 6).alias("total"), F.round(F.array_max("v"), 6).alias("highest"), F.size("v").cast("bigint").alias("n"))


def char_gram_tokens(t: Tables) -> DataFrame:
    """The grams one by one; ``_char_guessed`` counts the same without listing them."""
    return _labelled(t).withColumn("tokens", learning.char_grams(F.col("text")))


def _char_guessed(t: Tables) -> DataFrame:
    guessed = grams.held_out(_labelled(t), "text", "label", learning.logistic, FOLDS, 500)
    return guessed.select("doc_id", "fold", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))


@query("l5_char_tfidf")
def l5(t: Tables) -> DataFrame:
    return macro_f1(_char_guessed(t).select("y", "yhat"))


FEATURES = ["n_chars", "n_words", "n_lines", "alpha", "digits"]


def _featured(t: Tables) -> DataFrame:
    c = F.col("text")
    columns = {"n_words": word_count(c), "n_lines": F.size(F.split(c, "\n")), "alpha": alpha_ratio(c), "digits": digit_ratio(c), "n_chars": F.length(c)}
    return learning.assembled(_labelled(t).withColumns(columns), FEATURES)


@query("l6_boosting")
def l6(t: Tables) -> DataFrame:
    return _guessed(_featured(t), learning.boosted).select("doc_id", "yhat")


@query("l7_forest")
def l7(t: Tables) -> DataFrame:
    return _guessed(_featured(t), learning.forest).select("doc_id", "yhat")


@query("l10_model_comparison")
def l10(t: Tables) -> DataFrame:
    return learning.out_of_fold(_featured(t), "label", {"boosted": trees.boosted, "forest": trees.forest, "logistic": learning.logistic}, FOLDS)


def _fold_scores(guessed: dict[str, DataFrame], name: str) -> DataFrame:
    """(fold, name, macro_f1, weighted_f1) of out-of-fold predictions (fold, y, yhat) by name."""
    cells = [df.groupBy("fold", "y", "yhat").agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.lit(key)) for key, df in guessed.items()]
    return fold_scores(reduce(DataFrame.unionByName, cells), ["fold", name])


@query("l12_paradigms")
def l12(t: Tables) -> DataFrame:
    """(fold, approach, macro_f1): every approach is scored on the same rows, fold by fold."""
    ruled = (rule_field(F.col("text")) != "other").cast("int")
    approaches = {
        "char_tfidf": _char_guessed(t),
        "features": _guessed(_featured(t).drop("text"), trees.boosted, together=False),
        "rules": _labelled(t).select("fold", F.col("label").cast("int").alias("y"), ruled.alias("yhat")),
    }
    return _fold_scores(approaches, "approach").select("fold", "approach", "macro_f1")


@query("l13_ablation")
def l13(t: Tables) -> DataFrame:
    held = _featured(t).drop("features")
    kept = {"baseline": set(), "no_sizes": {"n_chars", "n_words", "n_lines"}, "no_ratios": {"alpha", "digits"}}
    guessed = {name: _guessed(learning.assembled(held, [f for f in FEATURES if f not in dropped]), learning.boosted) for name, dropped in kept.items()}
    return _fold_scores(guessed, "model").select("fold", "model", "macro_f1", "weighted_f1")


@query("l14_origin_report")
def l14(t: Tables) -> DataFrame:
    """Every labelled document counts; one without a prediction as class 1."""
    truth = t.labels.select("doc_id", F.col("quality").alias("y"))
    guessed = truth.join(l4(t).select("doc_id", "yhat"), "doc_id", "left")
    return class_report(guessed.select("y", F.coalesce("yhat", F.lit(1)).alias("yhat")))


@query("l15_triage_forest")
def l15(t: Tables) -> DataFrame:
    held = _featured(t).withColumn("label", (F.col("n_chars") > 500).cast("double"))
    guessed = _guessed(held, lambda label: learning.forest(label, trees=100, depth=5))
    return guessed.select("doc_id", F.col("yhat").alias("readable"))


#: Trials of the search, and its folds; its seed.
TRIALS, INNER, SEED = 5, 3, 42


def trials(n: int = TRIALS, seed: int = SEED) -> list[dict[str, float]]:
    """Points of the five-parameter space, drawn at random; the learning rate evenly by its logarithm. Trees have no
    bound on their leaves here, so that parameter bounds their depth once more."""
    rng = random.Random(seed)
    drawn = lambda: (rng.randint(50, 150), rng.randint(3, 7), math.exp(rng.uniform(math.log(0.05), math.log(0.2))), rng.randint(15, 40), rng.randint(10, 30))
    return [dict(zip(("rounds", "depth", "rate", "leaves", "least_rows"), drawn(), strict=True)) for _ in range(n)]


@query("l16_tuning")
def l16(t: Tables) -> DataFrame:
    """(trial, parameters, macro_f1): the cross-validated score of each trial over all labelled rows. The search is random
    instead of guided, as the guided sampler isn't to be had here, and made once, not once for each outer fold."""
    held = _featured(t).withColumn("inner", F.pmod(F.xxhash64("doc_id"), F.lit(INNER)).cast("int")).cache()
    held.count()
    spark = t.spark

    def scored(job: tuple[int, dict[str, float], int]) -> list[tuple]:
        nth, point, inner = job
        train, test = held.where(F.col("inner") != inner), held.where(F.col("inner") == inner)
        booster = learning.boosted("label", point["rounds"], min(point["depth"], math.ceil(math.log2(point["leaves"]))))
        booster = booster.setStepSize(point["rate"]).setMinInstancesPerNode(point["least_rows"])
        guessed = booster.fit(learning.balanced_weight(train, "label").coalesce(1)).transform(test)
        cells = confusion(guessed.select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"))).collect()
        return [(nth, *point.values(), inner, r["y"], r["yhat"], r["n"]) for r in cells]

    jobs = [(nth, point, inner) for nth, point in enumerate(trials()) for inner in range(INNER)]
    with ThreadPoolExecutor(8) as pool:
        rows = [row for rows in pool.map(scored, jobs) for row in rows]
    held.unpersist()
    keys = ["trial", "rounds", "depth", "rate", "leaves", "least_rows"]
    cells = spark.createDataFrame(rows, "trial int, rounds int, depth int, rate double, leaves int, least_rows int, inner int, y int, yhat int, n long")
    return fold_scores(cells, [*keys, "inner"]).groupBy(*keys).agg(F.avg("macro_f1").alias("macro_f1"))
