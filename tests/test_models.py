"""Invariants of learned models: splits, folds, persistence, Shapley additivity, planted signal."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quarry.operators import explain as ex
from quarry.operators import models as md
from quarry.operators import prepare as dp
from quarry.plans.fixtures import doc_model
from quarry.sources import registry as reg

from data_dirs import SF001, SF01


@pytest.fixture(scope="module")
def prep(spark):
    return dp.prepare_dataset(doc_model(spark, SF01), target="quality", key="doc_id")


def test_split_disjoint_and_complete(spark, prep):
    n = doc_model(spark, SF01).count()
    tr, te = prep.train.select("doc_id"), prep.test.select("doc_id")
    assert tr.count() + te.count() == n
    assert tr.join(te, "doc_id").count() == 0


def test_folds_cover_rows(spark, prep):
    f = md.fold_column(prep.train, "doc_id", 5).groupBy("_fold").count().collect()
    assert len(f) == 5 and sum(r["count"] for r in f) == prep.train.count()


def test_stratified_folds_deal_out_every_class(spark):
    rows = [(i, "rare" if i < 7 else None if i < 20 else "common") for i in range(500)]
    df = spark.createDataFrame(rows + rows[:3], "id int, label string")
    folds = md.fold_column(df, "id", 5, stratify="label")
    assert folds.count() == 503
    assert folds.select("id", "_fold").distinct().count() == 500  # rows of one key stay together
    for label, n in (("rare", 7), (None, 13), ("common", 480)):
        sizes = [r["count"] for r in folds.where(F.col("label").eqNullSafe(F.lit(label))).dropDuplicates(["id"])
                 .groupBy("_fold").count().collect()]
        assert sum(sizes) == n and len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_svm_uses_class_weights(spark, prep):
    train = prep.preprocessor.fit(prep.train).transform(prep.train)
    for weighted in (False, True):
        stage = md.candidate_models("classification", profile="fast", class_weight=weighted)["SVM"].stages(train)[-1]
        assert stage.isSet("weightCol") is weighted


def test_tree_beats_majority_and_roundtrips(spark, prep, tmp_path):
    res = md.train_one(prep, md.candidate_models("classification", profile="fast")["Decision Tree"],
                       "classification", cv=0)
    assert res.error is None
    majority = prep.test.groupBy("quality").count().agg(F.max("count") / F.sum("count")).first()[0] * 100
    assert res.metrics["accuracy"] >= majority - 1e-9
    run = str(tmp_path / "run one")
    reg.save_run(spark, run, res.model, {"model": "Decision Tree", "problem_type": "classification"}, res.metrics)
    model, meta, metrics = reg.load_run(spark, run)
    a = res.model.transform(prep.test).select("doc_id", "predicted_label")
    b = model.transform(prep.test).select("doc_id", "predicted_label")
    assert a.exceptAll(b).count() == 0 and meta["model"] == "Decision Tree" and metrics == res.metrics


def test_missing_run_is_reported(spark, tmp_path):
    with pytest.raises(reg.RunNotFoundError):
        reg.load_run(spark, str(tmp_path / "nope"))


def test_shapley_sums_to_prediction_minus_base(spark, prep):
    res = md.train_one(prep, md.candidate_models("classification", profile="fast")["Logistic Regression"],
                       "classification", cv=0)
    shap = ex.shapley_values(res.model, prep.test, prep.train, "doc_id", prep.feature_columns, "classification",
                             rows=5, permutations=3, background_rows=5)
    total = shap.groupBy("doc_id").agg(F.sum("contribution").alias("s"), F.first("base").alias("base"))
    out = ex._model_output(res.model, prep.test, "classification").select("doc_id", "_out")
    for r in total.join(out, "doc_id").collect():
        assert abs(r["s"] - (r["_out"] - r["base"])) < 1e-9


def test_unknown_problem_type(spark):
    with pytest.raises(ValueError):
        md.candidate_models("ranking")


def test_training_queries_run_the_whole_job(spark, monkeypatch):
    """All learners, reference profile, 5 folds."""
    from types import SimpleNamespace

    from quarry.plans import catalog

    calls = []

    def train_all(prep, cv=md.CV_FOLDS, tune=False, class_weight=False, profile="reference", only=None, parallelism=1, progress=None):
        calls.append((prep.problem_type, cv, profile, only))
        return [md.TrainResult(n, None, {"accuracy": i / 10, "r2": i / 10}, 0.5, 0.1, 1.0, 1.0, 3)
                for i, n in enumerate(md.candidate_models(prep.problem_type))]
    monkeypatch.setattr(md, "train_all", train_all)
    boards = {k: catalog.QUERIES[k](spark, SF001).collect() for k in (
        "train_and_compare", "select_best", "compact_leaderboard", "train_all", "model_leaderboard")}
    assert calls == [("classification", 5, "reference", None)] * 3 + [("regression", 5, "reference", None)] * 2
    assert {k: len(v) for k, v in boards.items()} == {
        "train_and_compare": 9, "select_best": 1, "compact_leaderboard": 9, "train_all": 6, "model_leaderboard": 6}
    assert boards["select_best"][0].model == "Naive Bayes"
    seen = {}
    monkeypatch.setattr(catalog, "run_analysis", lambda *a, **kw: seen.update(kw) or SimpleNamespace(record=None))
    catalog.QUERIES["run_pipeline"](spark, SF001)
    assert not {"cv", "profile", "only"} & set(seen)


@pytest.mark.parametrize("name", ["Decision Tree", "Logistic Regression"])
def test_exact_shapley_values_add_up(spark, prep, name):
    res = md.train_one(prep, md.candidate_models("classification")[name], "classification", cv=0)
    shap = ex.shap_values(res.model, prep.test, prep.train, "doc_id", prep.feature_columns, "classification", rows=6)
    total = shap.groupBy("doc_id").agg((F.sum("contribution") + F.first("base")).alias("s"))
    out = res.model.transform(prep.test)
    want = vector_to_array("rawPrediction")[1] if name == "Logistic Regression" else vector_to_array("probability")[1]
    rows = total.join(out.select("doc_id", want.alias("w")), "doc_id").collect()
    assert len(rows) == 6 and all(abs(r.s - r.w) < 1e-9 for r in rows)


def test_folds_are_prepared_once_for_all_settings(spark, prep):
    store = md.TrainingStore(prep, "classification")
    assert store.folds(3) is store.folds(3)
    cand = md.candidate_models("classification")["Decision Tree"]
    both = md.cross_validate(store, cand, [{"maxDepth": 1}, {"maxDepth": 6}], 3)
    assert both == [md.cross_validate(store, cand, [p], 3)[0] for p in ({"maxDepth": 1}, {"maxDepth": 6})]
