"""Model queries predict every labelled document out of fold."""

import pytest

from tessera.plans import catalog, models

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    return {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()}


@pytest.mark.parametrize("name", ["l4_word_tfidf_logistic", "l6_boosting", "l7_forest", "l15_triage_forest"])
def test_each_document_is_predicted_once(spark, labelled, name):
    got = [r.doc_id for r in catalog.queries()[name](spark, FOLDER).collect()]
    assert len(got) == len(set(got)) and set(got) == labelled


@pytest.mark.parametrize(("name", "kind"), [("l10_model_comparison", "model"), ("l12_paradigms", "approach"), ("l13_ablation", "model")])
def test_each_fold_is_scored(spark, name, kind):
    got = [(r[kind], r.fold) for r in catalog.queries()[name](spark, FOLDER).collect()]
    assert sorted(got) == sorted((k, f) for k in {k for k, _ in got} for f in range(5))


def test_missing_predictions_count_as_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 2 else "gamma delta") for i in range(20)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2 if i < 20 else 0, 0) for i in range(23)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["class"]: r for r in catalog.queries()["l14_origin_report"](spark, str(tmp_path)).collect()}
    assert got[0].support == 13 and got[0].recall == pytest.approx(10 / 13) and got[1].support == 10 and got[1].precision == pytest.approx(10 / 13)


def test_forest_is_of_the_reference_size(spark, monkeypatch):
    made = []
    monkeypatch.setattr(models.learning, "held_out", lambda df, label, make, folds: made.append(make(label)) or df.withColumn("prediction", df.label))
    catalog.queries()["l7_forest"](spark, FOLDER)
    assert [(m.getNumTrees(), m.getMaxDepth()) for m in made] == [(200, 10)]
