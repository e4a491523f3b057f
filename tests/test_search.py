"""Seeded trial plan, real Spark ML fits on a small learnable fixture,
artefact round trips."""

import json

import pytest
from pyspark.sql import functions as F

from equilens.operators import history as hi
from equilens.operators import prep as pp
from equilens.operators import search as se
from equilens.sources import store
from equilens.spec import AuditSpec, MODEL_FAMILIES

SPEC = AuditSpec()


def test_trial_plan_is_seeded_and_in_range():
    a, b = se.trial_rows(), se.trial_rows()
    assert a == b and len(a) == 50
    assert {t["model_type"] for t in a} <= set(MODEL_FAMILIES)
    for t in a:
        p = json.loads(t["params"])
        assert 0.3 <= t["cut"] <= 0.7
        if p["model_type"] == "random_forest":
            assert 100 <= p["rf_n_estimators"] <= 500 and 5 <= p["rf_max_depth"] <= 30
        if p["model_type"] == "logistic_regression":
            assert 0.001 <= p["lr_C"] <= 10 and p["lr_penalty"] in ("l1", "l2", "elasticnet")
    assert se.trial_rows(seed=7) != a


def learnable(spark, n=400):
    # y depends on x1; g is independent
    return spark.range(n).select(
        F.col("id"), ((F.col("id") * 37) % 100 / 100.0).alias("x1"), ((F.col("id") * 11) % 7 / 7.0).alias("x2"),
        (F.col("id") % 2).cast("int").alias("g")).withColumn(
        "y", (((F.col("id") * 37) % 100) >= 60).cast("int")).withColumn("fold", (F.col("id") % 3).cast("int"))


def test_families_fit_and_rank(spark):
    df = learnable(spark)
    fams = [
        {"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": 1.0},
        {"model_type": "random_forest", "rf_n_estimators": 10, "rf_max_depth": 5, "rf_min_samples_split": 4,
         "rf_min_samples_leaf": 1},
        {"model_type": "gbt_leafwise", "lgbm_n_estimators": 5, "lgbm_max_depth": 10, "lgbm_learning_rate": 0.1,
         "lgbm_num_leaves": 20, "lgbm_subsample": 1.0, "lgbm_colsample_bytree": 1.0},
    ]
    from equilens.operators.metrics import ranking_metrics
    for p in fams:
        m = se.fit_family(df, p, ["x1", "x2"], "y", n_rows=400)
        sc = se.predict_scores(m, df, ["x1", "x2"], "p_model")
        auc = ranking_metrics(sc, SPEC.with_(score="p_model")).first().roc_auc
        assert auc > 0.9, p["model_type"]
    assert all(t.leaves() <= 20 for t in m.trees)   # the last one: grown by leaf, see test_leafwise


def test_cv_search_history_and_best(spark):
    df = learnable(spark).checkpoint(eager=True)
    trials = [
        {"trial": 0, "model_type": "logistic_regression", "cut": 0.5,
         "params": json.dumps({"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": 1.0})},
        {"trial": 1, "model_type": "random_forest", "cut": 0.5,
         "params": json.dumps({"model_type": "random_forest", "rf_n_estimators": 5, "rf_max_depth": 3,
                               "rf_min_samples_split": 2, "rf_min_samples_leaf": 1})},
        {"trial": 2, "model_type": "logistic_regression", "cut": 0.5,
         "params": json.dumps({"model_type": "logistic_regression", "lr_penalty": "bogus", "lr_C": -1.0})},
    ]
    hist = se.cv_search(df, SPEC, ["x1", "x2"], trials)
    rows = {r.trial: r for r in hist.collect()}
    assert rows[2].score == 0.0                  # a failed configuration scores 0
    assert rows[0].score > 0.6 and rows[1].score > 0.6
    best = hi.best_trial(hist).first()
    assert best.trial in (0, 1)
    top = hi.top_trials(hist, 2).collect()
    assert [r.trial for r in top][0] == best.trial


def test_preprocessor_statistics_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0), (3, 5.0, 6.0)], "id long, a double, b double")
    p = pp.Preprocessor(["a", "b"]).fit(df)
    store.write_table(p.statistics(), str(tmp_path / "stats"))
    q = pp.Preprocessor.from_statistics(spark.read.parquet(str(tmp_path / "stats")))
    x = {r.id: (r.a, r.b) for r in p.transform(df).collect()}
    y = {r.id: (r.a, r.b) for r in q.transform(df).collect()}
    assert all(x[k] == pytest.approx(y[k]) for k in x)
    assert x[1][1] == pytest.approx(0.0)         # imputed with the median 5.0, which is the mean too


def test_bundle_and_summary(spark, tmp_path):
    df = learnable(spark, 90)
    m = se.fit_family(df, {"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": 1.0}, ["x1", "x2"], "y",
                      n_rows=90)
    from equilens.operators.fairness import fairness_report
    sc = se.predict_scores(m, df, ["x1", "x2"], "p").withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    rep = fairness_report(sc, SPEC)
    store.save_bundle(str(tmp_path / "b"), model=m, report=rep)
    b = store.load_bundle(spark, str(tmp_path / "b"))
    assert b["model"] is not None and b["thresholds"] is None
    assert store.model_report(spark, str(tmp_path / "b")).count() == 1
    assert store.model_report(spark, str(tmp_path / "nothing")) is None
    assert store.read_raw_decisions(spark, str(tmp_path / "nothing.data"), on_missing="report") is None
    best = spark.createDataFrame([("logistic_regression", "{}")], "model_type string, params string")
    store.write_summary(rep, best, {"train": [90, 2], "test": [0, 2]}, str(tmp_path / "summary"))
    doc = spark.read.json(str(tmp_path / "summary")).first()
    assert doc.best_model_type == "logistic_regression" and doc.performance_metrics.accuracy is not None
    assert list(doc.data_shape.train) == [90, 2]
    hist = spark.createDataFrame([(0, "x", 0.5, "{}")], "trial int, model_type string, score double, params string")
    store.write_history(hist, str(tmp_path / "hist"))
    assert spark.read.parquet(str(tmp_path / "hist/parquet")).count() == 1


def test_refit_best_uses_cv_parameters(spark):
    df = learnable(spark, 120)
    hist = spark.createDataFrame([
        (0, "logistic_regression", 0.7, json.dumps({"model_type": "logistic_regression", "lr_penalty": "elasticnet",
                                                     "lr_C": 2.0, "lr_l1_ratio": 0.25})),
        (1, "random_forest", 0.6, json.dumps({"model_type": "random_forest", "rf_n_estimators": 3, "rf_max_depth": 2,
                                               "rf_min_samples_split": 2, "rf_min_samples_leaf": 1}))],
        "trial int, model_type string, score double, params string")
    trial, params, model = se.refit_best(df, hist, ["x1", "x2"], "y")
    assert trial == 0 and params["lr_l1_ratio"] == 0.25
    assert model.getElasticNetParam() == 0.25          # the l1 ratio survives the refit
    assert model.getRegParam() == pytest.approx(1 / (2.0 * 120))


def test_audit_job_end_to_end(spark, tmp_path):
    from equilens.audit_job import run_audit_job
    trials = [
        {"trial": 0, "model_type": "logistic_regression", "cut": 0.5,
         "params": json.dumps({"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": 1.0})},
        {"trial": 1, "model_type": "random_forest", "cut": 0.45,
         "params": json.dumps({"model_type": "random_forest", "rf_n_estimators": 5, "rf_max_depth": 4,
                               "rf_min_samples_split": 2, "rf_min_samples_leaf": 1})},
    ]
    res = run_audit_job(spark, "/root/testdata/sf0.001", str(tmp_path / "job"), trials=trials)
    rep = res["report"].first()
    assert rep.composite_score is not None and 0 <= rep.accuracy <= 1
    assert res["history"].count() == 2
    assert {r.g for r in res["thresholds"].collect()} == {0, 1}
    doc = spark.read.json(str(tmp_path / "job/summary")).first()
    assert doc.total_trials == 2
    split = store.load_split(spark, str(tmp_path / "job/split"))
    assert split.where("split = 'train'").where(F.col("weight").isNull()).count() == 0


def test_registered_search_has_all_families_as_drawn():
    from equilens.plans import q_ml
    trials = q_ml.search_trials()
    assert {t["model_type"] for t in trials} == set(MODEL_FAMILIES)
    assert trials == se.trial_rows()[:len(trials)]


def test_registered_search_fits_the_drawn_parameters(spark, monkeypatch):
    from equilens.plans import q_ml
    seen = []
    monkeypatch.setattr(q_ml, "prepared", lambda spark, sf: (spark, None))
    monkeypatch.setattr(q_ml.mg, "kfold", lambda df, spec: df)
    monkeypatch.setattr(q_ml, "write_once", lambda df, name: df)
    monkeypatch.setattr(q_ml.se, "cv_search", lambda df, spec, features, trials, **kw: seen.extend(trials))
    q_ml.q_search_fits(spark.range(3), None)
    assert seen == se.trial_rows()[:8]


def test_each_family_gets_its_own_weight(spark, monkeypatch):
    """R4 for depth-wise boosting, R3 for the others, in search, refit and single fits."""
    from equilens.plans import q_ml
    used = {}

    def estimator(params, features_col="features", label_col="y", weight_col=None, **kw):
        used[params["model_type"]] = weight_col
        raise ValueError("not fitted here")

    def leafwise(df, params, features, label="y", weight=None, fold=None, folds=()):
        used[params["model_type"]] = weight
        raise ValueError("not fitted here")

    monkeypatch.setattr(se, "family_estimator", estimator)
    monkeypatch.setattr(se, "fit_leafwise", leafwise)
    df = learnable(spark, 60).withColumn("weight", F.lit(1.0)).withColumn("weight_pos", F.lit(2.0))
    with pytest.raises(ValueError, match="no trial"):
        se.cv_search(df, SPEC, ["x1", "x2"], q_ml.search_trials(), weight_col=q_ml.WEIGHTS)
    assert used == {"random_forest": "weight", "gbt": "weight_pos", "gbt_leafwise": "weight", "logistic_regression": "weight"}
    from equilens import audit_job
    assert audit_job.WEIGHTS == q_ml.WEIGHTS


def test_search_resumes_and_concurrent_equals_sequential(spark, tmp_path, monkeypatch):
    df = learnable(spark).checkpoint(eager=True)
    trials = [{"trial": k, "model_type": "logistic_regression", "cut": 0.5,
               "params": json.dumps({"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": c})} for k, c in enumerate([0.01, 1.0, 5.0])]
    trials.append({"trial": 3, "model_type": "gbt_leafwise", "cut": 0.45, "params": json.dumps(
        {"model_type": "gbt_leafwise", "lgbm_n_estimators": 4, "lgbm_max_depth": 4, "lgbm_learning_rate": 0.2, "lgbm_num_leaves": 6,
         "lgbm_subsample": 1.0, "lgbm_colsample_bytree": 1.0})})
    one = sorted(se.cv_search(df, SPEC, ["x1", "x2"], trials, most=1).collect())
    assert sorted(se.cv_search(df, SPEC, ["x1", "x2"], trials, folder=str(tmp_path), most=4).collect()) == one

    def refuse(*a, **kw):
        raise AssertionError("fitted again")

    monkeypatch.setattr(se, "fit_family", refuse)
    monkeypatch.setattr(se, "fit_leafwise", refuse)
    assert sorted(se.cv_search(df, SPEC, ["x1", "x2"], trials, folder=str(tmp_path)).collect()) == one


def test_a_fault_ends_the_search(spark):
    def slow():
        return spark.range(10).count()

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        se.at_once([slow, broken, slow, slow], spark, 2)
    assert se.at_once([slow, slow, slow], spark, 2) == [10, 10, 10]
