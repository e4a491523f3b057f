"""End-to-end audit and mitigation job (the batch driver of the audited
pipeline, as one Spark application):

split (exact, stratified on label x group) -> preparation fitted on train ->
reweighing x balanced class weights -> k folds -> seeded search with Spark ML
fits and the composite objective -> refit of the best trial -> group
thresholds fitted on training scores -> scored test set -> report, history,
top trials, family statistics and a summary document written under ``out``.

    python -m equilens.audit_job --sf /root/testdata/sf0.01 --out /shared/audit --trials 50
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import history as hi
from .operators import mitigate as mg
from .operators import prep as pp
from .operators import search as se
from .operators import thresholds as th
from .operators.fairness import fairness_report
from .session import write_once
from .sources import store
from .sources.frames import FEATURES, decision_frame
from .spec import CV_FOLDS, DECISIONS, N_TRIALS, AuditSpec

#: R4 for depth-wise boosting, R3 (balanced) for the other families.
WEIGHTS = {"gbt": "weight_pos", "*": "weight"}


def run_audit_job(spark: SparkSession, sf_dir: str, out: str, trials: list[dict] | None = None,
                  n_trials: int = N_TRIALS, spec: AuditSpec = DECISIONS) -> dict[str, DataFrame]:
    frame = decision_frame(spark, sf_dir, features=True).select(spec.id, spec.label, spec.group, *FEATURES)

    def create() -> DataFrame:
        split = write_once(mg.holdout_exact(frame, spec), "split")
        prep = pp.Preprocessor(FEATURES).fit(split.where(F.col("split") == "train"))
        store.save_bundle(f"{out}/bundle", preprocessor_stats=prep.statistics())
        data = prep.transform(split)
        train = data.where(F.col("split") == "train")
        train = mg.reweighing(train, spec, out="w_fair")
        train = mg.class_weights(train, spec, base_weight="w_fair", out="weight")
        train = mg.positive_class_weight(train, spec, base_weight="w_fair", out="weight_pos")
        train = mg.kfold(train, spec, CV_FOLDS)
        # the split table keeps both weights as columns (saved and reloaded together)
        return train.unionByName(data.where(F.col("split") == "test"), allowMissingColumns=True)

    # a rerun into the same folder keeps the split and the preprocessor that it finds
    store.split_or_create(spark, f"{out}/split", spec.with_(weight="weight"), FEATURES, create)
    train = store.load_split(spark, f"{out}/split", "train")
    test = store.load_split(spark, f"{out}/split", "test")

    plan = trials if trials is not None else se.trial_rows(n_trials)
    hist = se.cv_search(train, spec, FEATURES, plan, fold="fold", weight_col=WEIGHTS, folder=f"{out}/search")
    hist = write_once(hist, "history")
    store.write_history(hist, f"{out}/history")
    best_no, params, model = se.refit_best(train, hist, FEATURES, spec.label, WEIGHTS)

    cut = float(next(t["cut"] for t in plan if int(t["trial"]) == int(best_no)))
    train_scored = se.predict_scores(model, train, FEATURES, "p_model")
    mspec = spec.with_(score="p_model", pred="pred_model")
    thresholds = write_once(th.fit_thresholds(train_scored, mspec), "thresholds")
    test_scored = se.predict_scores(model, test, FEATURES, "p_model")
    test_scored = th.apply_thresholds(test_scored, mspec, thresholds, out="pred_model")
    report = fairness_report(test_scored, mspec)
    store.save_bundle(f"{out}/bundle", model=model, thresholds=thresholds, report=report)

    n_train, n_test = train.count(), test.count()
    best = hist.where(F.col("trial") == int(best_no)).select("model_type", "params")
    store.write_summary(report, best, {"train": [n_train, len(FEATURES)], "test": [n_test, len(FEATURES)]},
                        f"{out}/summary", total_trials=len(plan))
    return {"report": report, "history": hist, "top_trials": hi.top_trials(hist),
            "family_stats": hi.family_stats(hist), "thresholds": thresholds,
            "best": spark.createDataFrame([(int(best_no), json.dumps(params, sort_keys=True), cut)],
                                          "trial int, params string, cut double")}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--sf", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--trials", type=int, default=N_TRIALS)
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    from .session import get_session
    spark = get_session(a.master)
    res = run_audit_job(spark, a.sf, a.out, n_trials=a.trials)
    res["report"].show(truncate=False)
    res["top_trials"].show()
    res["family_stats"].show()


if __name__ == "__main__":
    main()
