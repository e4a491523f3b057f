"""Registered queries: model comparison, cross-validated search objective on
given scores, search history analysis (M9, L7-L9, L11, K1-K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as hi
from ..operators import mitigate as mg
from ..operators import search as se
from ..operators.fairness import fairness_report
from ..sources.frames import decision_frame
from ..spec import DECISIONS
from .registry import register
from .sqlframes import DECISIONS as D, unrounded, with_

# --- fixed values: the scorers compared by ``model_comparison`` ------------
# (model name, score expression, decision cut)
SCORERS = (("surrogate", "p", 0.5), ("surrogate_cut45", "p", 0.45), ("price_score", "price_p", 0.5))
PRICE_SCALE = 500000.0
# ---------------------------------------------------------------------------


def stacked_models(spark, sf):
    """Long table (model, id, y, g, p, pred): one block per scorer, built by
    an explode over a fixed array of scorers (no union of scans)."""
    df = decision_frame(spark, sf).withColumn(
        "price_p", F.least(F.col("o_totalprice") / F.lit(PRICE_SCALE), F.lit(1.0)))
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(s).alias("p"),
                             (F.col(s) >= F.lit(c)).cast("int").alias("pred")) for m, s, c in SCORERS])
    return df.select("id", "y", "g", F.explode(arr).alias("m")).select("m.model", "id", "y", "g", "m.p", "m.pred")


STACK_RAW = """,
st AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{m}' AS model, id, y, g, {('least(o_totalprice / 500000.0, 1.0)' if s == 'price_p' else 'p')} AS p, "
    f"CAST({('least(o_totalprice / 500000.0, 1.0)' if s == 'price_p' else 'p')} >= {c} AS INTEGER) AS pred FROM d"
    for m, s, c in SCORERS) + """),
cm AS (SELECT model, CAST(count_if(y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND pred = 1) AS BIGINT) AS fp,
              CAST(count_if(y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count_if(y = 1 AND pred = 1) AS BIGINT) AS tp
       FROM st GROUP BY model),
sc AS (SELECT model, p AS s, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
              CAST(sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg
       FROM st WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY model, p),
rc AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
                 sum(neg) OVER (PARTITION BY model ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
       FROM sc),
rk AS (SELECT model,
              round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                         THEN sum(neg * (cum_pos - CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END, 6) AS roc_auc,
              round(CASE WHEN sum(pos) <> 0
                         THEN sum(CAST(pos * cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE)) / CAST(sum(pos) AS DOUBLE) END, 6) AS average_precision
       FROM rc GROUP BY model),
pr AS (SELECT model,
              count_if(y = 0 AND g <> 1) / count_if(y IS NOT NULL AND g <> 1) AS ru,
              count_if(y = 0 AND g = 1) / count_if(y IS NOT NULL AND g = 1) AS rp,
              count_if(pred = 0 AND g <> 1) / count_if(pred IS NOT NULL AND g <> 1) AS pru,
              count_if(pred = 0 AND g = 1) / count_if(pred IS NOT NULL AND g = 1) AS prp,
              coalesce(count_if(y = 0 AND pred = 0 AND g <> 1) / nullif(count_if(y = 0 AND pred IS NOT NULL AND g <> 1), 0), 0) AS tu,
              coalesce(count_if(y = 0 AND pred = 0 AND g = 1) / nullif(count_if(y = 0 AND pred IS NOT NULL AND g = 1), 0), 0) AS tpp
       FROM st GROUP BY model),
fm AS (SELECT model, round(CASE WHEN rp <> 0 THEN ru / rp END, 6) AS disparate_impact,
              round(ru - rp, 6) AS statistical_parity_difference, round(tu - tpp, 6) AS equal_opportunity_difference,
              round(CASE WHEN prp <> 0 THEN pru / prp END, 6) AS prediction_disparate_impact,
              round(pru - prp, 6) AS prediction_statistical_parity_difference FROM pr),
perf AS (SELECT cm.model,
  round(CASE WHEN tn + fp + fn + tp <> 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tn + fp + fn + tp AS DOUBLE) END, 6) AS accuracy,
  round(CASE WHEN tp + fn <> 0 AND tn + fp <> 0
             THEN (CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) + CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE)) / 2
             WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE)
             WHEN tn + fp <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1_score,
  roc_auc, average_precision
  FROM cm JOIN rk ON cm.model = rk.model),
rep AS (SELECT perf.*, disparate_impact, statistical_parity_difference, equal_opportunity_difference,
               prediction_disparate_impact, prediction_statistical_parity_difference
        FROM perf JOIN fm ON perf.model = fm.model),
rep2 AS (SELECT model, @SHOWN@,
  coalesce(disparate_impact >= 0.8 AND disparate_impact <= 1.25, false) AS di_pass,
  coalesce(abs(statistical_parity_difference) <= 0.1, false) AS spd_pass,
  coalesce(abs(equal_opportunity_difference) <= 0.1, false) AS eod_pass,
  coalesce(disparate_impact >= 0.8 AND disparate_impact <= 1.25, false)
    AND coalesce(abs(statistical_parity_difference) <= 0.1, false) AS parity_compliant,
  coalesce(disparate_impact >= 0.8 AND disparate_impact <= 1.25, false)
    AND coalesce(abs(statistical_parity_difference) <= 0.1, false)
    AND coalesce(abs(equal_opportunity_difference) <= 0.1, false) AS all_fair,
  round(0.7 * ((balanced_accuracy + f1_score + coalesce(roc_auc, 0.5)) / 3.0)
        + 0.3 * (1.0 - ((CASE WHEN disparate_impact < 0.8 THEN 0.8 - disparate_impact ELSE 0.0 END)
                        + abs(statistical_parity_difference))), 6) AS composite_score
  FROM rep)"""
_SHOWN = ", ".join(f"round(rep.{c}, 6) AS {c}" for c in (
    "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision",
    "disparate_impact", "statistical_parity_difference", "equal_opportunity_difference",
    "prediction_disparate_impact", "prediction_statistical_parity_difference"))
# verdicts and the score are taken from unrounded values, the columns are rounded in the last SELECT
STACK_SQL = STACK_RAW[:STACK_RAW.index("rep2 AS")]
STACK_SQL = unrounded(STACK_SQL) + STACK_RAW[STACK_RAW.index("rep2 AS"):].replace("@SHOWN@", _SHOWN)


@register("model_comparison", with_(D) + STACK_SQL + "\nSELECT * FROM rep2", rows="M9")
def q_model_comparison(spark, sf):
    return fairness_report(stacked_models(spark, sf), DECISIONS, ["model"])


@register("best_model", with_(D) + STACK_SQL + """
SELECT model, composite_score FROM rep2 ORDER BY composite_score DESC, model LIMIT 1""", rows="K2")
def q_best_model(spark, sf):
    rep = fairness_report(stacked_models(spark, sf), DECISIONS, ["model"])
    b = rep.agg(F.max(F.struct(F.col("composite_score"), F.col("model"))).alias("b"))
    return b.select(F.col("b.model").alias("model"), F.col("b.composite_score").alias("composite_score"))


# ---- cross-validated objective of the seeded trials on the surrogate score ----

TRIALS = se.trial_rows()


def _cv_sql() -> str:
    vals = ", ".join(f"({t['trial']}, '{t['model_type']}', CAST({t['cut']} AS DOUBLE), '{t['params']}')" for t in TRIALS)
    return """,
fo AS (SELECT id, y, g, p,
              CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '-fold-42')) > count(*) OVER (PARTITION BY y) // 3)
         AS INTEGER) + CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '-fold-42')) > 2 * count(*) OVER (PARTITION BY y) // 3) AS INTEGER) AS fold
       FROM d),
tr(trial, model_type, cut, params) AS (VALUES """ + vals + """),
col AS (SELECT fold, g, y, p, count(*) AS c FROM fo WHERE g IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL
        GROUP BY fold, g, y, p),
per AS (SELECT trial, model_type, cut, fold,
               sum(CASE WHEN y <> 0 AND p >= cut THEN c ELSE 0 END) AS tp,
               sum(CASE WHEN y = 0 AND p >= cut THEN c ELSE 0 END) AS fp,
               sum(CASE WHEN y <> 0 AND p < cut THEN c ELSE 0 END) AS fn,
               sum(CASE WHEN y = 0 AND p < cut THEN c ELSE 0 END) AS tn,
               sum(CASE WHEN g <> 1 AND p < cut THEN c ELSE 0 END) AS fav_u, sum(CASE WHEN g <> 1 THEN c ELSE 0 END) AS n_u,
               sum(CASE WHEN g = 1 AND p < cut THEN c ELSE 0 END) AS fav_p, sum(CASE WHEN g = 1 THEN c ELSE 0 END) AS n_p
        FROM col, tr GROUP BY trial, model_type, cut, fold),
m AS (SELECT trial, model_type, cut, fold,
             CASE WHEN tp + fn <> 0 AND tn + fp <> 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
                  WHEN tp + fn <> 0 THEN tp / (tp + fn) WHEN tn + fp <> 0 THEN tn / (tn + fp) END AS bal,
             CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
             CASE WHEN n_p <> 0 AND fav_p <> 0 THEN (fav_u / n_u) / (fav_p / n_p) END AS di,
             fav_u / n_u - fav_p / n_p AS spd
      FROM per),
fsc AS (SELECT fold, p AS s, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
               CAST(sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg
        FROM fo WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY fold, p),
frc AS (SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos
        FROM fsc),
fau AS (SELECT fold, sum(neg * (cum_pos - CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS roc_auc
        FROM frc GROUP BY fold),
fs AS (SELECT m.*, 0.7 * ((bal + f1 + coalesce(roc_auc, 0.5)) / 3.0)
                   + 0.3 * (1.0 - ((CASE WHEN di < 0.8 THEN 0.8 - di ELSE 0.0 END) + abs(spd))) AS fold_score
       FROM m LEFT JOIN fau ON m.fold = fau.fold),
cv AS (SELECT trial, model_type, cut, round(avg(fold_score), 6) AS score, CAST(count(*) AS BIGINT) AS n_folds
       FROM fs GROUP BY trial, model_type, cut),
hist AS (SELECT cv.trial, cv.model_type, cv.score, tr.params FROM cv JOIN tr ON cv.trial = tr.trial)"""


CV_SQL = _cv_sql()


def _cv(spark, sf):
    df = mg.kfold(decision_frame(spark, sf), DECISIONS)
    return se.evaluate_cuts(df, DECISIONS, TRIALS)


def history(spark, sf):
    """(trial, model_type, score, params) of the seeded search on the data."""
    cv = _cv(spark, sf)
    plan = se.trial_table(spark).select("trial", "params")
    return cv.join(F.broadcast(plan), "trial").select("trial", "model_type", "score", "params")


@register("cv_objective", with_(D) + CV_SQL + "\nSELECT trial, model_type, cut, score, n_folds FROM cv",
          rows="L7 L8")
def q_cv_objective(spark, sf):
    return _cv(spark, sf)


@register("trial_history", with_(D) + CV_SQL + "\nSELECT * FROM hist", rows="L11 S8")
def q_trial_history(spark, sf):
    return history(spark, sf)


@register("best_trial", with_(D) + CV_SQL + """
SELECT trial, model_type, score, params FROM hist ORDER BY score DESC, trial LIMIT 1""", rows="L9")
def q_best_trial(spark, sf):
    return hi.best_trial(history(spark, sf))


@register("top_trials", with_(D) + CV_SQL + """
SELECT trial, model_type, score FROM hist ORDER BY score DESC, trial LIMIT 5""", rows="K1")
def q_top_trials(spark, sf):
    return hi.top_trials(history(spark, sf))


@register("family_stats", with_(D) + CV_SQL + """
SELECT model_type, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score,
       CAST(count(*) AS BIGINT) AS n_trials FROM hist GROUP BY model_type""", rows="K3")
def q_family_stats(spark, sf):
    return hi.family_stats(history(spark, sf))


@register("family_counts", with_(D) + CV_SQL + """
SELECT model_type, CAST(count(*) AS BIGINT) AS n_trials FROM hist GROUP BY model_type""", rows="K4")
def q_family_counts(spark, sf):
    return hi.family_counts(history(spark, sf))


@register("score_progress", with_(D) + CV_SQL + """
SELECT trial, score, max(score) OVER (ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM hist""", rows="K5")
def q_score_progress(spark, sf):
    return hi.score_progress(history(spark, sf))
