"""Seeded model search.

* ``trial_table`` (L7): the seeded search plan: for each trial a model family,
  that family's parameters and a decision cut. Values come from an integer
  hash of (seed, trial, parameter), so the plan is identical on every run and
  can be written out as SQL ``VALUES``. It replaces a sequential sampler, so
  all trials can be evaluated at once.
* ``evaluate_cuts`` (L8 on given scores): cross-validated composite objective
  of every trial's cut on an existing score column, in one pass over the
  data: rows are bucketed by the sorted trial cuts, counted per
  (fold, group, label, bucket), and every trial's confusion counts are read
  off running totals of that small table (no rows x trials product).
* ``fit_family`` / ``cv_search`` (L1-L6, L8-L10): real fits per trial and
  fold, several at a time in a bounded pool of driver threads; every fit and
  every metric is a distributed job, each (trial, fold) pair's validation
  scores are a table of their own, which a later run takes up, and all of them
  are scored by one grouped report.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..session import scratch_path, write_once
from ..spec import FAIRNESS_WEIGHT, MODEL_FAMILIES, N_TRIALS, RANDOM_SEED, AuditSpec
from .fairness import composite_col
from .forest import Forest
from .leafwise import Boosting, fit_leafwise
from .linear import fit_linear, held_out_scores
from .linear import settings as linear_settings
from .metrics import ranking_metrics

#: Fits of a search at a time.
FITS_AT_ONCE = 8

# --- fixed values: search space of each family -----------------------------
# (name, kind, low, high); kind: int, float, logfloat, choice
SEARCH_SPACE = {
    "random_forest": (("rf_n_estimators", "int", 100, 500), ("rf_max_depth", "int", 5, 30),
                      ("rf_min_samples_split", "int", 2, 20), ("rf_min_samples_leaf", "int", 1, 10)),
    "gbt": (("xgb_n_estimators", "int", 100, 500), ("xgb_max_depth", "int", 3, 10),
                ("xgb_learning_rate", "logfloat", 0.01, 0.3), ("xgb_subsample", "float", 0.6, 1.0),
                ("xgb_colsample_bytree", "float", 0.6, 1.0)),
    "gbt_leafwise": (("lgbm_n_estimators", "int", 100, 500), ("lgbm_max_depth", "int", 3, 15),
                 ("lgbm_learning_rate", "logfloat", 0.01, 0.3), ("lgbm_num_leaves", "int", 20, 100),
                 ("lgbm_subsample", "float", 0.6, 1.0), ("lgbm_colsample_bytree", "float", 0.6, 1.0)),
    "logistic_regression": (("lr_penalty", "choice", ("l1", "l2", "elasticnet"), None),
                            ("lr_C", "logfloat", 0.001, 10.0)),
}
ELASTICNET_RATIO = ("lr_l1_ratio", "float", 0.0, 1.0)
CUT_RANGE = (0.3, 0.7)
# ---------------------------------------------------------------------------

_M = 2147483647


def _uniform(seed: int, trial: int, j: int) -> float:
    x = (seed * 1000003 + trial * 7919 + j * 104729 + 1) % _M
    for _ in range(3):
        x = (x * 48271) % _M
    return x / _M


def _draw(kind, lo, hi, u):
    if kind == "int":
        return int(lo + math.floor(u * (hi - lo + 1)))
    if kind == "float":
        return round(lo + u * (hi - lo), 6)
    if kind == "logfloat":
        return round(math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo))), 6)
    if kind == "choice":
        return lo[int(math.floor(u * len(lo)))]
    raise ValueError(kind)


def trial_rows(n_trials: int = N_TRIALS, seed: int = RANDOM_SEED) -> list[dict]:
    """The seeded trial plan (trial, model_type, cut, params JSON)."""
    out = []
    for t in range(n_trials):
        fam = MODEL_FAMILIES[int(math.floor(_uniform(seed, t, 0) * len(MODEL_FAMILIES)))]
        params = {"model_type": fam}
        space = list(SEARCH_SPACE[fam])
        for j, (name, kind, lo, hi) in enumerate(space, start=1):
            params[name] = _draw(kind, lo, hi, _uniform(seed, t, j))
        if fam == "logistic_regression" and params["lr_penalty"] == "elasticnet":
            name, kind, lo, hi = ELASTICNET_RATIO
            params[name] = _draw(kind, lo, hi, _uniform(seed, t, 9))
        cut = round(CUT_RANGE[0] + _uniform(seed, t, 10) * (CUT_RANGE[1] - CUT_RANGE[0]), 3)
        out.append({"trial": t, "model_type": fam, "cut": cut, "params": json.dumps(params, sort_keys=True)})
    return out


def trial_table(spark: SparkSession, n_trials: int = N_TRIALS, seed: int = RANDOM_SEED) -> DataFrame:
    rows = trial_rows(n_trials, seed)
    return spark.createDataFrame([(r["trial"], r["model_type"], float(r["cut"]), r["params"]) for r in rows],
                                 "trial int, model_type string, cut double, params string")


def evaluate_cuts(df: DataFrame, spec: AuditSpec, trials: Sequence[dict], fold: str = "fold",
                  weight: float = FAIRNESS_WEIGHT, per_fold: bool = False) -> DataFrame:
    """L8 on a given score: per trial the mean over folds of the composite
    (balanced accuracy, F1, fold AUC; prediction-based DI / SPD) of the
    decision ``score >= cut``. One pass over the rows."""
    spark = df.sparkSession
    cuts = sorted({float(t["cut"]) for t in trials})
    g, y, p = F.col(spec.group), F.col(spec.label), F.col(spec.score)
    bucket = sum(((p >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    base = df.where(g.isNotNull() & y.isNotNull() & p.isNotNull())
    counts = base.groupBy(F.col(fold).alias("fold"), F.col(spec.group).alias("grp"), F.col(spec.label).alias("lab"),
                          bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    # folds x groups x labels x (trials + 1) rows: evaluated once, read three times below
    counts = write_once(counts, "cut-counts")
    # dense (fold, group, label, bucket) grid: a few hundred rows
    keys = counts.select("fold", "grp", "lab").distinct()
    grid = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(cuts)))).alias("b"))
    dense = grid.join(counts, ["fold", "grp", "lab", "b"], "left").fillna(0, ["c"])
    w = Window.partitionBy("fold", "grp", "lab").orderBy(F.col("b").desc()) \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dense = dense.withColumn("n_at_or_above", F.sum("c").over(w)) \
                 .withColumn("n_total", F.sum("c").over(Window.partitionBy("fold", "grp", "lab")))
    tt = spark.createDataFrame([(int(t["trial"]), t["model_type"], float(t["cut"]), cuts.index(float(t["cut"])) + 1)
                                for t in trials], "trial int, model_type string, cut double, b int")
    # each trial meets exactly its own bucket row of every (fold, group, label): an equi-join
    per = dense.join(F.broadcast(tt), "b").select(
        "trial", "model_type", "cut", "fold", "grp", "lab",
        F.col("n_at_or_above").alias("pos"), F.col("n_total").alias("tot"))
    priv = F.col("grp") == F.lit(spec.privileged)
    fav = F.lit(spec.favorable)
    agg = per.groupBy("trial", "model_type", "cut", "fold").agg(
        F.sum(F.when(F.col("lab") != fav, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("lab") == fav, F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("lab") != fav, F.col("tot") - F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("lab") == fav, F.col("tot") - F.col("pos")).otherwise(0)).alias("tn"),
        F.sum(F.when(~priv, F.col("tot") - F.col("pos")).otherwise(0)).alias("fav_u"),
        F.sum(F.when(~priv, F.col("tot")).otherwise(0)).alias("n_u"),
        F.sum(F.when(priv, F.col("tot") - F.col("pos")).otherwise(0)).alias("fav_p"),
        F.sum(F.when(priv, F.col("tot")).otherwise(0)).alias("n_p"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rec1 = F.when(tp + fn != 0, tp / (tp + fn))
    rec0 = F.when(tn + fp != 0, tn / (tn + fp))
    bal = F.when(rec1.isNotNull() & rec0.isNotNull(), (rec1 + rec0) / 2).otherwise(F.coalesce(rec1, rec0))
    f1 = F.when(2 * tp + fp + fn != 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    ru = F.when(F.col("n_u") != 0, F.col("fav_u") / F.col("n_u"))
    rp = F.when(F.col("n_p") != 0, F.col("fav_p") / F.col("n_p"))
    m = agg.select("trial", "model_type", "cut", "fold", bal.alias("bal"), f1.alias("f1"),
                   F.when(rp != 0, ru / rp).alias("di"), (ru - rp).alias("spd"))
    auc = ranking_metrics(df.withColumnRenamed(fold, "fold"), spec, ["fold"], rounded=False).select("fold", "roc_auc")
    m = m.join(F.broadcast(auc), "fold", "left")   # one row per fold
    m = m.withColumn("fold_score", composite_col(F.col("bal"), F.col("f1"), F.col("roc_auc"), F.col("di"),
                                                 F.col("spd"), weight))
    if per_fold:
        return m
    # the mean is rounded once, at the end: trials that differ only by the order of summation must tie
    return m.groupBy("trial", "model_type", "cut").agg(r6(F.avg("fold_score")).alias("score"),
                                                       F.count(F.lit(1)).alias("n_folds"))


# ---- Spark ML fits (L1-L6, L9, L10) -----------------------------------------

def family_estimator(params: dict, features_col: str = "features", label_col: str = "y",
                     weight_col: str | None = None, seed: int = RANDOM_SEED, n_rows: float | None = None):
    """Map one trial's parameters to an estimator.

    random_forest -> ``forest.Forest`` (min split has no twin: least rows of a leaf =
    max(leaf, ceil(split / 2))); gbt -> ``leafwise.Boosting`` (gbt_leafwise is fitted by
    ``leafwise`` too); logistic_regression -> LogisticRegression with
    regParam = 1 / (C * n) with n the total sample weight (the row count when
    unweighted) and elasticNetParam 1 (l1), 0 (l2) or the l1 ratio.
    The trial's ``cut``, an extension of ours, is applied to the scores, not to the model.
    """
    from pyspark.ml.classification import LogisticRegression
    fam = params["model_type"]
    common = dict(featuresCol=features_col, labelCol=label_col)
    if weight_col:
        common["weightCol"] = weight_col
    if fam == "random_forest":
        return Forest(params, label_col, weight_col)
    if fam == "gbt":
        return Boosting(params, label_col, weight_col)
    if fam == "logistic_regression":
        pen = params["lr_penalty"]
        enet = {"l1": 1.0, "l2": 0.0}.get(pen, float(params.get("lr_l1_ratio", 0.5)))
        reg = 1.0 / (float(params["lr_C"]) * float(n_rows or 1.0))
        return LogisticRegression(maxIter=1000, regParam=reg, elasticNetParam=enet, standardization=False, **common)
    raise ValueError(f"unknown model family {fam}")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


#: An instance weight: one column for all families, or a column by family (``*``: the others).
Weights = str | dict[str, str] | None


def weight_of(params: dict, weights: Weights) -> str | None:
    return weights.get(params["model_type"], weights.get("*")) if isinstance(weights, dict) else weights


def fit_family(train: DataFrame, params: dict, features: Sequence[str], label: str = "y",
               weight_col: Weights = None, n_rows: float | None = None):
    """L1-L4: fit one family on an assembled frame (``features`` vector column
    built here). For the linear family the regularisation is scaled by the
    total weight, taken from one aggregate when not given."""
    weight_col = weight_of(params, weight_col)
    if params.get("model_type") == "gbt_leafwise":
        return fit_leafwise(train, params, features, label, weight_col)[0]
    if params.get("model_type") == "logistic_regression" and n_rows is None:
        n_rows = total_weight(train, weight_col)
    est = family_estimator(params, "features", label, weight_col, n_rows=n_rows)
    if isinstance(est, Forest):
        return est.fit(train, features)
    if isinstance(est, Boosting):
        return est.fit(train, features)[0]
    return est.fit(assemble(train, features))


def total_weight(df: DataFrame, weight_col: str | None) -> float:
    """Sum of instance weights (row count when unweighted): one aggregate value."""
    if weight_col is None:
        return float(df.count())
    return float(df.agg(F.sum(weight_col)).first()[0] or 0.0)


def refit_best(train: DataFrame, hist: DataFrame, features: Sequence[str], label: str = "y",
               weight_col: Weights = None):
    """The best trial of a history table (highest score, lowest trial on
    ties) refitted on all training rows with the same parameter row that
    drove its cross-validation (so no parameter is lost on refit)."""
    from .history import best_trial
    best = best_trial(hist).first()
    params = json.loads(best["params"])
    return best["trial"], params, fit_family(train, params, features, label, weight_col)


def predict_scores(model, df: DataFrame, features: Sequence[str], out: str = "p_model") -> DataFrame:
    """P(class 1) from the probability vector (vector_to_array, no Python UDF)."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(assemble(df, features))
    return scored.withColumn(out, vector_to_array("probability")[1]) \
                 .drop("features", "probability", "rawPrediction", "prediction")


def feature_importances(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importances (trees) or coefficients (linear) joined to feature names."""
    if hasattr(model, "importances"):
        vals = model.importances
    elif hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    if len(vals) != len(features):
        raise ValueError(f"{len(vals)} importances for {len(features)} features")
    return spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "feature string, importance double")


def at_once(jobs: list, spark: SparkSession, most: int) -> list:
    """Results of the calls, in order, at most ``most`` at a time in driver threads that
    inherit the caller's local properties. Each has a scheduler pool of its own (used where
    the scheduler is fair) and all share a job group: the first fault cancels what still runs
    and is raised."""
    from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

    from pyspark import inheritable_thread_target
    sc, group = spark.sparkContext, f"search-{uuid.uuid4().hex[:12]}"

    def tagged(k: int, job):
        sc.setJobGroup(group, f"{group} {k}", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", f"search-{k % most}")
        return job()

    with ThreadPoolExecutor(most) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(tagged), k, job) for k, job in enumerate(jobs)]
        ended, left = wait(futures, return_when=FIRST_EXCEPTION)
        if any(f.exception() for f in ended):
            for f in left:
                f.cancel()
            sc.cancelJobGroup(group)
    fault = next((f.exception() for f in futures if not f.cancelled() and f.exception()), None)
    if fault is not None:
        raise fault
    return [f.result() for f in futures]


def cv_search(df: DataFrame, spec: AuditSpec, features: Sequence[str], trials: Sequence[dict],
              fold: str = "fold", weight_col: Weights = None, folder: str | None = None, most: int = FITS_AT_ONCE) -> DataFrame:
    """L8 with real fits: for every trial and fold fit on the other folds,
    score the held-out fold, stack all validation scores with (trial, fold)
    keys and compute every report in one grouped job. Parity is that of the
    decision, so models with different decisions differ in fairness. Parameters
    that a family rejects score 0 with their ``reason``; a lost executor, a
    missing column or any other fault is raised.

    ``most`` fits run at a time (boosting trials fit all their folds together,
    linear trials all of theirs in the same rounds, ``linear``). Each pair's
    scores are written to ``folder`` (a fresh one in the shared scratch folder,
    if not given), those of the linear trials as one table; what an earlier run
    completed there is read, not fitted again.
    Returns the history table (trial, model_type, score, params, reason)."""
    from ..sources.store import path_exists
    from .fairness import fairness_report
    spark = df.sparkSession
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # k values (3)
    folder = folder or scratch_path(spark, "search")
    plans = {int(t["trial"]): (json.loads(t["params"]), float(t["cut"])) for t in trials}

    def place(trial: int, k: int) -> str:
        return f"{folder}/trial-{trial}-fold-{k}"

    def scored(trial: int, k: int, model) -> None:
        sc = predict_scores(model, df.where(F.col(fold) == k).select(spec.id, spec.label, spec.group, *features), features, "p_model")
        sc.select(F.lit(trial).alias("trial"), F.lit(int(k)).alias("fold"), spec.id, spec.label, spec.group, "p_model",
                  (F.col("p_model") >= F.lit(plans[trial][1])).cast("int").alias("pred_model")).write.mode("overwrite").parquet(place(trial, k))

    def job(trial: int, ks: list[int]):
        def run() -> tuple[int, str | None]:
            params = plans[trial][0]
            try:
                if params["model_type"] == "gbt_leafwise":
                    for k, model in zip(ks, fit_leafwise(df, params, features, spec.label, weight_of(params, weight_col), fold, ks), strict=True):
                        scored(trial, k, model)
                elif params["model_type"] == "gbt":
                    est = family_estimator(params, "features", spec.label, weight_of(params, weight_col))
                    for k, model in zip(ks, est.fit(df, features, fold, ks), strict=True):
                        scored(trial, k, model)
                else:
                    for k in ks:
                        scored(trial, k, fit_family(df.where(F.col(fold) != k), params, features, spec.label, weight_col))
            except (IllegalArgumentException, ValueError) as e:   # parameters the family rejects; anything else is raised
                return trial, str(e)[:500]
            return trial, None
        return run

    failed: dict[int, str] = {}
    linear: dict[int, dict] = {}
    for t in sorted(plans):
        if plans[t][0]["model_type"] == "logistic_regression":
            try:
                linear_settings(plans[t][0])
                # what the family's single estimator refuses, the shared rounds refuse too
                family_estimator(plans[t][0], "features", spec.label, weight_of(plans[t][0], weight_col))
                linear[t] = plans[t][0]
            except (IllegalArgumentException, ValueError) as e:
                failed[t] = str(e)[:500]
    # the linear trials' table is named by its trials, so a run with others makes one of its own
    together = f"{folder}/linear-{hashlib.md5(json.dumps(linear, sort_keys=True).encode()).hexdigest()[:12]}"

    def all_linear() -> tuple[int, str | None]:
        first = next(iter(linear))
        try:
            models = fit_linear(df, linear, features, spec.label, weight_of(linear[first], weight_col), fold, folds)
        except ValueError as e:   # a fold without rows to train on
            failed.update({t: str(e)[:500] for t in linear})
            return first, str(e)[:500]
        sc = held_out_scores(df, models, features, fold, [spec.id, spec.label, spec.group])
        cut = F.element_at(F.create_map(*[F.lit(x) for t in linear for x in (t, plans[t][1])]), F.col("trial"))
        sc.withColumn("pred_model", (F.col("p_model") >= cut).cast("int")).write.mode("overwrite").parquet(together)
        return first, None

    fits = {t: p for t, p in plans.items() if p[0]["model_type"] != "logistic_regression"}
    todo = {t: [k for k in folds if not path_exists(spark, f"{place(t, k)}/_SUCCESS")] for t in fits}
    # a trial's folds one by one, but those of boosting together; boosting, the longest, first
    order = sorted(fits, key=lambda t: (not plans[t][0]["model_type"].startswith("gbt"), t))
    jobs = [job(t, part) for t in order if todo[t]
            for part in ([todo[t]] if plans[t][0]["model_type"].startswith("gbt") else [[k] for k in todo[t]])]
    if linear and not path_exists(spark, f"{together}/_SUCCESS"):
        jobs.append(all_linear)
    failed.update({t: reason for t, reason in at_once(jobs, spark, most) if reason is not None})
    stacked = [spark.read.parquet(place(t, k)) for t in fits if t not in failed for k in folds]
    if any(t not in failed for t in linear):
        stacked.append(spark.read.parquet(together))
    if not stacked:
        raise ValueError("no trial could be fitted")
    allv = stacked[0]
    for s in stacked[1:]:
        allv = allv.unionByName(s)
    mspec = spec.with_(score="p_model", pred="pred_model")
    rep = fairness_report(allv, mspec, ["trial", "fold"], parity_on=mspec.pred, rounded=False)
    per_trial = rep.groupBy("trial").agg(r6(F.avg("composite_score")).alias("score"))
    tt = trial_table(spark, 0) if not trials else spark.createDataFrame(
        [(int(t["trial"]), t["model_type"], t["params"]) for t in trials], "trial int, model_type string, params string")
    hist = tt.join(per_trial, "trial", "left").withColumn(
        "score", F.when(F.col("trial").isin(list(failed)), F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0))))
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in failed.items() for x in kv]), F.col("trial")) if failed else F.lit(None).cast("string")
    return hist.select("trial", "model_type", "score", "params", reason.alias("reason"))
