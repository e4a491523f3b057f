"""Registered queries: classification performance and fairness."""

from __future__ import annotations

from ..operators import fairness as fm
from ..operators import metrics as mt
from ..sources.frames import decision_frame, document_frame
from ..spec import DECISIONS
from .registry import register
from .sqlframes import DECISIONS as D, DOCUMENTS, with_, unrounded

# ---- SQL building blocks (DuckDB) -----------------------------------------
CM = """
cm AS (
  SELECT CAST(count_if(y = 0 AND pred = 0) AS BIGINT) AS tn,
         CAST(count_if(y = 0 AND pred = 1) AS BIGINT) AS fp,
         CAST(count_if(y = 1 AND pred = 0) AS BIGINT) AS fn,
         CAST(count_if(y = 1 AND pred = 1) AS BIGINT) AS tp,
         CAST(count_if(y IS NULL OR pred IS NULL) AS BIGINT) AS n_excluded
  FROM d)"""

PERF_COLS = """
  round(CASE WHEN tn + fp + fn + tp <> 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tn + fp + fn + tp AS DOUBLE) END, 6) AS accuracy,
  round(CASE WHEN tp + fn <> 0 AND tn + fp <> 0
             THEN (CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) + CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE)) / 2
             WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE)
             WHEN tn + fp <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1_score"""

RANK = """
sc AS (
  SELECT p AS s, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg
  FROM d WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY p),
rc AS (
  SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
            sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
  FROM sc),
rk AS (
  SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                    THEN sum(neg * (cum_pos - CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END, 6) AS roc_auc,
         round(CASE WHEN sum(pos) <> 0
                    THEN sum(CAST(pos * cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE)) / CAST(sum(pos) AS DOUBLE) END, 6) AS average_precision
  FROM rc)"""

# favourable = 0, privileged g = 1; label sums (_l) and prediction sums (_p)
PAR = """
ps AS (
  SELECT CAST(count_if(y IS NOT NULL AND g <> 1) AS BIGINT) AS n_u,
         CAST(count_if(y = 0 AND g <> 1) AS BIGINT) AS f_u,
         CAST(count_if(y IS NOT NULL AND g = 1) AS BIGINT) AS n_p,
         CAST(count_if(y = 0 AND g = 1) AS BIGINT) AS f_p,
         CAST(count_if(pred IS NOT NULL AND g <> 1) AS BIGINT) AS pn_u,
         CAST(count_if(pred = 0 AND g <> 1) AS BIGINT) AS pf_u,
         CAST(count_if(pred IS NOT NULL AND g = 1) AS BIGINT) AS pn_p,
         CAST(count_if(pred = 0 AND g = 1) AS BIGINT) AS pf_p,
         CAST(count_if(y = 0 AND pred IS NOT NULL AND g <> 1) AS BIGINT) AS e_nu,
         CAST(count_if(y = 0 AND pred = 0 AND g <> 1) AS BIGINT) AS e_hu,
         CAST(count_if(y = 0 AND pred IS NOT NULL AND g = 1) AS BIGINT) AS e_np,
         CAST(count_if(y = 0 AND pred = 0 AND g = 1) AS BIGINT) AS e_hp
  FROM d),
pr AS (
  SELECT CASE WHEN n_u <> 0 THEN CAST(f_u AS DOUBLE) / CAST(n_u AS DOUBLE) END AS ru,
         CASE WHEN n_p <> 0 THEN CAST(f_p AS DOUBLE) / CAST(n_p AS DOUBLE) END AS rp,
         CASE WHEN pn_u <> 0 THEN CAST(pf_u AS DOUBLE) / CAST(pn_u AS DOUBLE) END AS pru,
         CASE WHEN pn_p <> 0 THEN CAST(pf_p AS DOUBLE) / CAST(pn_p AS DOUBLE) END AS prp,
         coalesce(CASE WHEN e_nu <> 0 THEN CAST(e_hu AS DOUBLE) / CAST(e_nu AS DOUBLE) END, 0) AS tu,
         coalesce(CASE WHEN e_np <> 0 THEN CAST(e_hp AS DOUBLE) / CAST(e_np AS DOUBLE) END, 0) AS tpp
  FROM ps),
fm AS (
  SELECT round(CASE WHEN rp <> 0 THEN ru / rp END, 6) AS disparate_impact,
         round(ru - rp, 6) AS statistical_parity_difference,
         round(tu - tpp, 6) AS equal_opportunity_difference,
         round(CASE WHEN prp <> 0 THEN pru / prp END, 6) AS prediction_disparate_impact,
         round(pru - prp, 6) AS prediction_statistical_parity_difference
  FROM pr)"""

STATUS = """
  coalesce(disparate_impact >= 0.8 AND disparate_impact <= 1.25, false) AS di_pass,
  coalesce(abs(statistical_parity_difference) <= 0.1, false) AS spd_pass,
  coalesce(abs(equal_opportunity_difference) <= 0.1, false) AS eod_pass,
  coalesce(disparate_impact >= 0.8 AND disparate_impact <= 1.25, false)
    AND coalesce(abs(statistical_parity_difference) <= 0.1, false) AS parity_compliant,
  coalesce(disparate_impact >= 0.8 AND disparate_impact <= 1.25, false)
    AND coalesce(abs(statistical_parity_difference) <= 0.1, false)
    AND coalesce(abs(equal_opportunity_difference) <= 0.1, false) AS all_fair"""

COMPOSITE = """
  round(0.7 * ((balanced_accuracy + f1_score + coalesce(roc_auc, 0.5)) / 3.0)
        + 0.3 * (1.0 - ((CASE WHEN disparate_impact < 0.8 THEN 0.8 - disparate_impact ELSE 0.0 END)
                        + abs(statistical_parity_difference))), 6) AS composite_score"""


def _dec(spark, sf):
    return decision_frame(spark, sf)


@register("confusion", with_(D, CM) + "SELECT tn, fp, fn, tp, n_excluded FROM cm", rows="C1")
def q_confusion(spark, sf):
    return mt.confusion(_dec(spark, sf), DECISIONS)


@register("performance", with_(D, CM) + "SELECT" + PERF_COLS + " FROM cm", rows="C2-C6")
def q_performance(spark, sf):
    return mt.performance(_dec(spark, sf), DECISIONS)


@register("roc_auc", with_(D, RANK) + "SELECT roc_auc FROM rk", rows="C7")
def q_roc_auc(spark, sf):
    return mt.ranking_metrics(_dec(spark, sf), DECISIONS).select("roc_auc")


@register("average_precision", with_(D, RANK) + "SELECT average_precision FROM rk", rows="C8")
def q_average_precision(spark, sf):
    return mt.ranking_metrics(_dec(spark, sf), DECISIONS).select("average_precision")


@register("performance_full", with_(D, CM, RANK) + "SELECT" + PERF_COLS + ", roc_auc, average_precision FROM cm, rk",
          rows="C9")
def q_performance_full(spark, sf):
    return mt.performance_full(_dec(spark, sf), DECISIONS)


@register("group_confusion", with_(D) + """
SELECT g, CAST(count_if(y = 0 AND pred = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND pred = 1) AS BIGINT) AS fp,
       CAST(count_if(y = 1 AND pred = 0) AS BIGINT) AS fn, CAST(count_if(y = 1 AND pred = 1) AS BIGINT) AS tp,
       round(CASE WHEN count_if(y = 0 AND pred IS NOT NULL) <> 0
                  THEN CAST(count_if(y = 0 AND pred = 0) AS DOUBLE) / CAST(count_if(y = 0 AND pred IS NOT NULL) AS DOUBLE) ELSE 0 END, 6) AS tpr,
       round(CASE WHEN count_if(y = 1 AND pred IS NOT NULL) <> 0
                  THEN CAST(count_if(y = 1 AND pred = 0) AS DOUBLE) / CAST(count_if(y = 1 AND pred IS NOT NULL) AS DOUBLE) ELSE 0 END, 6) AS fpr
FROM d WHERE g IS NOT NULL GROUP BY g""", rows="C10")
def q_group_confusion(spark, sf):
    return mt.group_confusion(_dec(spark, sf), DECISIONS)


@register("label_parity", with_(D, PAR) + """
SELECT round(ru, 6) AS favorable_rate_unprivileged, round(rp, 6) AS favorable_rate_privileged,
       round(CASE WHEN rp <> 0 THEN ru / rp END, 6) AS disparate_impact,
       round(ru - rp, 6) AS statistical_parity_difference FROM pr""", rows="M1 M2")
def q_label_parity(spark, sf):
    return fm.label_parity(_dec(spark, sf), DECISIONS)


@register("prediction_parity", with_(D, PAR) + """
SELECT round(pru, 6) AS favorable_rate_unprivileged, round(prp, 6) AS favorable_rate_privileged,
       round(CASE WHEN prp <> 0 THEN pru / prp END, 6) AS disparate_impact,
       round(pru - prp, 6) AS statistical_parity_difference FROM pr""", rows="M1 M2")
def q_prediction_parity(spark, sf):
    return fm.prediction_parity(_dec(spark, sf), DECISIONS)


@register("equal_opportunity", with_(D, PAR) + "SELECT round(tu - tpp, 6) AS equal_opportunity_difference FROM pr",
          rows="M3")
def q_equal_opportunity(spark, sf):
    return fm.equal_opportunity(_dec(spark, sf), DECISIONS)


@register("fairness_metrics", with_(D, PAR) + "SELECT * FROM fm", rows="M4")
def q_fairness_metrics(spark, sf):
    return fm.fairness_metrics(_dec(spark, sf), DECISIONS)


@register("fairness_status", with_(D, unrounded(PAR)) + """,
st AS (SELECT *, """ + STATUS + """ FROM fm)
SELECT metric, round(value, 6) AS value, passed, all_fair, parity_compliant FROM (
  SELECT 'disparate_impact' AS metric, disparate_impact AS value, di_pass AS passed, all_fair, parity_compliant FROM st
  UNION ALL SELECT 'statistical_parity_difference', statistical_parity_difference, spd_pass, all_fair, parity_compliant FROM st
  UNION ALL SELECT 'equal_opportunity_difference', equal_opportunity_difference, eod_pass, all_fair, parity_compliant FROM st)""",
          rows="M5 M6")
def q_fairness_status(spark, sf):
    return fm.fairness_status(_dec(spark, sf), DECISIONS)


@register("composite_score", with_(D, CM, unrounded(RANK), unrounded(PAR)) + """,
perf AS (SELECT""" + unrounded(PERF_COLS) + """ FROM cm)
SELECT""" + COMPOSITE + " FROM perf, rk, fm", rows="M7")
def q_composite_score(spark, sf):
    return fm.fairness_report(_dec(spark, sf), DECISIONS).select("composite_score")


ROUNDED = ", ".join(f"round(rep.{c}, 6) AS {c}" for c in (
    "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision",
    "disparate_impact", "statistical_parity_difference", "equal_opportunity_difference",
    "prediction_disparate_impact", "prediction_statistical_parity_difference"))
REPORT_SQL = """,
perf AS (SELECT""" + unrounded(PERF_COLS) + """, roc_auc, average_precision FROM cm, rk),
rep AS (SELECT * FROM perf, fm)
SELECT """ + ROUNDED + "," + STATUS + "," + COMPOSITE + """
FROM rep"""


@register("fairness_report", with_(D, CM, unrounded(RANK), unrounded(PAR)) + REPORT_SQL, rows="M8")
def q_fairness_report(spark, sf):
    return fm.fairness_report(_dec(spark, sf), DECISIONS)


@register("parity_by_group", with_(DOCUMENTS) + """,
pg AS (SELECT lang, CAST(count(*) AS BIGINT) AS n,
              CAST(count_if(y = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS favorable_rate
       FROM docs WHERE y IS NOT NULL AND lang IS NOT NULL GROUP BY lang),
rf AS (SELECT favorable_rate AS ref FROM pg WHERE lang = 'en')
SELECT lang, n, round(favorable_rate, 6) AS favorable_rate,
       round(CASE WHEN ref <> 0 THEN favorable_rate / ref END, 6) AS disparate_impact,
       round(favorable_rate - ref, 6) AS statistical_parity_difference
FROM pg, rf""", rows="M10")
def q_parity_by_group(spark, sf):
    return fm.parity_by_group(document_frame(spark, sf), "lang", "y", "en")


@register("approval_gap", with_(D) + """,
a AS (SELECT avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE g = 1) AS rp,
             avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE g = 0) AS ru FROM d WHERE y IS NOT NULL)
SELECT round(rp, 6) AS approval_rate_privileged, round(ru, 6) AS approval_rate_unprivileged,
       round((ru - rp) * 100, 6) AS gap_points, round(CASE WHEN rp <> 0 THEN ru / rp END, 6) AS approval_ratio
FROM a""", rows="B4 F1")
def q_approval_gap(spark, sf):
    from ..operators.audit import approval_gap
    return approval_gap(_dec(spark, sf), DECISIONS)


@register("parity_by_segment", with_(D) + """,
pg AS (SELECT segment, CAST(count(*) AS BIGINT) AS n,
              CAST(count_if(y = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS favorable_rate
       FROM d WHERE y IS NOT NULL AND segment IS NOT NULL GROUP BY segment),
rf AS (SELECT favorable_rate AS ref FROM pg WHERE segment = 'BUILDING')
SELECT segment, n, round(favorable_rate, 6) AS favorable_rate,
       round(CASE WHEN ref <> 0 THEN favorable_rate / ref END, 6) AS disparate_impact,
       round(favorable_rate - ref, 6) AS statistical_parity_difference
FROM pg, rf""", rows="M10")
def q_parity_by_segment(spark, sf):
    return fm.parity_by_group(_dec(spark, sf), "segment", "y", "BUILDING")
