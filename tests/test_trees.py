"""Trees over cells against Spark's trees over rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import learning, trees
from tessera.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """Columns of few values, so that both put their bounds between all of them."""
    rng = random.Random(1)
    found = []
    for i in range(1500):
        x = [float(rng.randrange(12)) for _ in range(4)]
        noise = rng.random() < 0.1
        found.append((i, float((x[0] > 5 and x[1] < 8 or x[2] * x[3] > 60) != noise), *x))
    df = spark.createDataFrame(found, "id long, label double, a double, b double, c double, d double")
    return learning.balanced_weight(learning.assembled(df, ["a", "b", "c", "d"]), "label").cache()


def predictions(model, df):
    return [r.prediction for r in model.transform(df).orderBy("id").select("prediction").collect()]


def test_boosting_is_that_of_spark(spark, rows):
    for rounds, least in ((1, 0.999), (20, 0.99)):
        mine = predictions(trees.boosted("label", rounds, 4).fit(rows), rows)
        theirs = predictions(learning.boosted("label", rounds, 4).fit(rows.coalesce(1)), rows)
        assert np.mean(np.array(mine) == np.array(theirs)) >= least


def test_forest_is_like_that_of_spark(spark, rows):
    mine = predictions(trees.forest("label", 60, 6).fit(rows), rows)
    theirs = predictions(learning.forest("label", 60, 6).fit(rows.coalesce(1)), rows)
    assert np.mean(np.array(mine) == np.array(theirs)) >= 0.95
    assert mine == predictions(trees.forest("label", 60, 6).fit(rows.repartition(5)), rows)


def test_repeated_rows_weigh_as_often(spark, rows):
    once = trees.boosted("label", 10, 4).fit(rows.withColumn("weight", 7 * F.col("weight")))
    often = trees.boosted("label", 10, 4).fit(rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(7)))))
    assert predictions(once, rows) == predictions(often, rows)


def test_draws_are_of_rows_not_of_cells():
    """A cell of 1,000 rows is drawn about 1,000 times, never left out nor doubled."""
    bins, y = np.array([[0], [1]], dtype=np.uint8), np.array([0, 1])
    for seed in range(20):
        *_, value = trees.bagged(bins, y, np.ones(2), np.array([1000, 1000]), 2, 0, (seed,))
        assert value[0, 0] == pytest.approx(0.5, abs=0.06)


def test_sizes_are_those_of_the_reference(spark, rows):
    assert len(trees.boosted("label").fit(rows).trees) == 100 and len(trees.forest("label").fit(rows).trees) == 200
    assert len(trees.forest("label", 30).fit(rows).trees) == 30


def jobs(spark, name):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    catalog.queries()[name](spark, FOLDER).collect()
    return scheduler.numTotalJobs() - before


@pytest.mark.parametrize(("name", "most"), [("l10_model_comparison", 600), ("l12_paradigms", 1200)])
def test_a_comparison_takes_no_job_for_each_level(spark, name, most):
    """Boosting took one for each level of each of its trees before, over all rows."""
    assert jobs(spark, name) < most
