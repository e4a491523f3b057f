"""Registered queries: weights, splits, preparation, thresholds and scoring
(R1-R6, T1-T3, E10-E12, H1-H6, O2-O6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import mitigate as mg
from ..operators import prep as pp
from ..operators import scoring as sc
from ..operators import thresholds as th
from ..operators.fairness import label_parity
from ..session import scratch_path, write_once
from ..sources.frames import FEATURES, decision_frame
from ..spec import DECISIONS
from .registry import register
from .sqlframes import DECISIONS as D, LINES, with_


def _split_sql(src: str) -> str:
    return f"""
sp AS (SELECT *, CASE WHEN substr(md5(CAST(id AS VARCHAR) || '-42'), 1, 8) < '33333333'
                      THEN 'test' ELSE 'train' END AS split FROM {src})"""


WEIGHTS_SQL = _split_sql("d") + """,
tr AS (SELECT * FROM sp WHERE split = 'train'),
c AS (SELECT g, y, count(*) AS n_gy FROM tr WHERE g IS NOT NULL AND y IS NOT NULL GROUP BY g, y),
w AS (SELECT g, y, CAST(sum(n_gy) OVER (PARTITION BY g) * sum(n_gy) OVER (PARTITION BY y) AS DOUBLE)
                   / CAST(sum(n_gy) OVER () * n_gy AS DOUBLE) AS weight FROM c),
rw AS (SELECT tr.id, tr.g, tr.y, tr.pred, coalesce(w.weight, 1.0) AS weight FROM tr LEFT JOIN w USING (g, y))"""


def _train(spark, sf):
    return mg.holdout_split(decision_frame(spark, sf), DECISIONS).where(F.col("split") == "train")


def _reweighed(spark, sf):
    return mg.reweighing(_train(spark, sf), DECISIONS)


@register("holdout_split", with_(D, _split_sql("d")) + "SELECT id, split FROM sp", rows="T1")
def q_holdout_split(spark, sf):
    return mg.holdout_split(decision_frame(spark, sf), DECISIONS).select("id", "split")


EXACT_SQL = """
hx AS (SELECT id, y, g, row_number() OVER (PARTITION BY y, g ORDER BY md5(CAST(id AS VARCHAR) || '-42')) AS rk,
              count(*) OVER (PARTITION BY y, g) AS ns FROM d),
hs AS (SELECT id, y, g, CASE WHEN rk <= (ns + 2) // 5 THEN 'test' ELSE 'train' END AS split FROM hx)"""


@register("holdout_exact", with_(D, EXACT_SQL) + "SELECT id, split FROM hs", rows="T1 E14")
def q_holdout_exact(spark, sf):
    return mg.holdout_exact(decision_frame(spark, sf), DECISIONS).select("id", "split")


@register("split_stats", with_(D, EXACT_SQL) + "SELECT split, y, CAST(count(*) AS BIGINT) AS n FROM hs GROUP BY split, y",
          rows="T2")
def q_split_stats(spark, sf):
    return mg.split_stats(mg.holdout_exact(decision_frame(spark, sf), DECISIONS), DECISIONS)


@register("kfold", with_(D) + """
SELECT id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '-fold-42')) > count(*) OVER (PARTITION BY y) // 3)
         AS INTEGER) + CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '-fold-42')) > 2 * count(*) OVER (PARTITION BY y) // 3) AS INTEGER) AS fold
FROM d""", rows="T3")
def q_kfold(spark, sf):
    return mg.kfold(decision_frame(spark, sf), DECISIONS).select("id", "y", "fold")


@register("reweighing", with_(D, WEIGHTS_SQL) + "SELECT id, g, y, round(weight, 6) AS weight FROM rw", rows="R1")
def q_reweighing(spark, sf):
    return _reweighed(spark, sf).select("id", "g", "y", r6("weight").alias("weight"))


@register("weight_range", with_(D, WEIGHTS_SQL) + """
SELECT round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight, CAST(count(*) AS BIGINT) AS n,
       CAST(count(DISTINCT round(weight, 6)) AS BIGINT) AS n_distinct FROM rw""", rows="R2")
def q_weight_range(spark, sf):
    w = _reweighed(spark, sf)
    return w.agg(r6(F.min("weight")).alias("min_weight"), r6(F.max("weight")).alias("max_weight"),
                 F.count(F.lit(1)).alias("n"), F.countDistinct(r6("weight")).alias("n_distinct"))


@register("class_weights", with_(D, WEIGHTS_SQL) + """,
cw AS (SELECT y, CAST(sum(count(*)) OVER () AS DOUBLE) / (2.0 * count(*)) AS class_weight FROM rw
       WHERE y IS NOT NULL GROUP BY y)
SELECT rw.id, rw.y, round(cw.class_weight, 6) AS class_weight, round(cw.class_weight * rw.weight, 6) AS weight
FROM rw LEFT JOIN cw USING (y)""", rows="R3")
def q_class_weights(spark, sf):
    w = _reweighed(spark, sf).withColumnRenamed("weight", "w_fair")
    out = mg.class_weights(w, DECISIONS, base_weight="w_fair")
    return out.select("id", "y", r6("class_weight").alias("class_weight"), r6("weight").alias("weight"))


@register("pos_weight", with_(D, WEIGHTS_SQL) + """
SELECT id, y, round(CASE WHEN y = 1 THEN 2.33 ELSE 1.0 END * weight, 6) AS weight FROM rw""", rows="R4")
def q_pos_weight(spark, sf):
    w = _reweighed(spark, sf).withColumnRenamed("weight", "w_fair")
    return mg.positive_class_weight(w, DECISIONS, base_weight="w_fair").select(
        "id", "y", r6("weight").alias("weight"))


@register("reweighing_effect", with_(D, WEIGHTS_SQL) + """,
a AS (SELECT count_if(y = 0 AND g <> 1) / count_if(y IS NOT NULL AND g <> 1) AS ru,
             count_if(y = 0 AND g = 1) / count_if(y IS NOT NULL AND g = 1) AS rp,
             sum(CASE WHEN y = 0 AND g <> 1 THEN weight ELSE 0 END) / sum(CASE WHEN g <> 1 THEN weight ELSE 0 END) AS wru,
             sum(CASE WHEN y = 0 AND g = 1 THEN weight ELSE 0 END) / sum(CASE WHEN g = 1 THEN weight ELSE 0 END) AS wrp
      FROM rw)
SELECT round(ru / rp, 6) AS di_before, round(ru - rp, 6) AS spd_before,
       round(wru / wrp, 6) AS di_after, round(wru - wrp, 6) + 0.0 AS spd_after FROM a""", rows="R5")
def q_reweighing_effect(spark, sf):
    w = _reweighed(spark, sf)
    before = label_parity(w, DECISIONS).select(F.col("disparate_impact").alias("di_before"),
                                               F.col("statistical_parity_difference").alias("spd_before"))
    after = label_parity(w, DECISIONS.with_(weight="weight")).select(
        F.col("disparate_impact").alias("di_after"), F.col("statistical_parity_difference").alias("spd_after"))
    from ..operators.metrics import join_rows
    return join_rows(before, after, ())


@register("undersample", with_(D) + """,
r AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(id AS VARCHAR) || '-sample-42')) AS rk
      FROM d WHERE y IS NOT NULL),
m AS (SELECT min(n) AS nmin FROM (SELECT count(*) AS n FROM r GROUP BY y))
SELECT id, y FROM r, m WHERE rk <= nmin""", rows="R6")
def q_undersample(spark, sf):
    return mg.undersample(decision_frame(spark, sf), DECISIONS).select("id", "y")


IMPUTE_COLS = ("qty_sum", "avg_discount")
SCALE_COLS = ("o_totalprice", "c_acctbal", "n_lines")


@register("impute_median", with_(D, LINES, _split_sql("df")) + """,
med AS (SELECT """ + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in IMPUTE_COLS) + """
        FROM sp WHERE split = 'train')
SELECT id, """ + ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), m_{c}), 6) AS {c}" for c in IMPUTE_COLS) + """
FROM sp, med""", rows="E10")
def q_impute_median(spark, sf):
    df = mg.holdout_split(decision_frame(spark, sf, features=True), DECISIONS)
    med = pp.fit_medians(df.where(F.col("split") == "train"), IMPUTE_COLS)
    return pp.impute(df.select("id", *IMPUTE_COLS), med, IMPUTE_COLS).select(
        "id", *[r6(c).alias(c) for c in IMPUTE_COLS])


@register("standardize", with_(D, LINES) + """,
st AS (SELECT """ + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS mu_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS sd_{c}"
                              for c in SCALE_COLS) + """ FROM df)
SELECT id, """ + ", ".join(
    f"round((CAST({c} AS DOUBLE) - mu_{c}) / CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 1 ELSE sd_{c} END, 6) AS {c}"
    for c in SCALE_COLS) + " FROM df, st", rows="E11")
def q_standardize(spark, sf):
    df = decision_frame(spark, sf, features=True).select("id", *SCALE_COLS)
    return pp.standardize(df, SCALE_COLS).select("id", *[r6(c).alias(c) for c in SCALE_COLS])


@register("prep_train_test", with_(D, LINES, _split_sql("df")) + """,
med AS (SELECT """ + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}" for c in FEATURES) + """
        FROM sp WHERE split = 'train'),
imp AS (SELECT id, split, """ + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in FEATURES) + """
        FROM sp, med),
st AS (SELECT """ + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATURES) + """
       FROM imp WHERE split = 'train')
SELECT id, split, """ + ", ".join(
    f"round(({c} - mu_{c}) / CASE WHEN sd_{c} IS NULL OR sd_{c} = 0 THEN 1 ELSE sd_{c} END, 6) AS {c}"
    for c in FEATURES) + " FROM imp, st", rows="E12 S6")
def q_prep_train_test(spark, sf):
    df = mg.holdout_split(decision_frame(spark, sf, features=True), DECISIONS).select("id", "split", *FEATURES)
    prep = pp.Preprocessor(FEATURES).fit(df.where(F.col("split") == "train"))
    return prep.transform(df).select("id", "split", *[r6(c).alias(c) for c in FEATURES])


# ---- thresholds -------------------------------------------------------------

def _threshold_sql(objective: str) -> str:
    cand_filter = "AND c0 > 0" if objective == "equal_opportunity" else ""
    obj = "abs(tpr - target_tpr)" if objective == "equal_opportunity" else \
        "abs(tpr - target_tpr) + abs(fpr - target_fpr)"
    return """
base AS (SELECT g, p, y FROM d WHERE g IS NOT NULL AND y IS NOT NULL AND p IS NOT NULL),
tgt AS (SELECT CASE WHEN count_if(g = 1 AND y = 0) <> 0
                    THEN count_if(g = 1 AND y = 0 AND p < 0.5) / count_if(g = 1 AND y = 0) ELSE 0.0 END AS target_tpr,
               CASE WHEN count_if(g = 1 AND y <> 0) <> 0
                    THEN count_if(g = 1 AND y <> 0 AND p < 0.5) / count_if(g = 1 AND y <> 0) ELSE 0.0 END AS target_fpr
        FROM base),
col AS (SELECT g, p AS s, CAST(count_if(y = 0) AS BIGINT) AS c0, CAST(count_if(y <> 0) AS BIGINT) AS c1
        FROM base WHERE g <> 1 GROUP BY g, p),
run AS (SELECT *, sum(c0) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum0,
                  sum(c1) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum1
        FROM col),
tot AS (SELECT g, sum(c0) AS n0, sum(c1) AS n1, sum(CASE WHEN s < 0.9 THEN c0 ELSE 0 END) AS b0hi,
               sum(CASE WHEN s < 0.9 THEN c1 ELSE 0 END) AS b1hi FROM col GROUP BY g),
cand AS (SELECT g, s AS t, cum0 - c0 AS b0, cum1 - c1 AS b1 FROM run WHERE s >= 0.1 AND s <= 0.9 """ + cand_filter + """
         UNION ALL SELECT g, CAST(0.9 AS DOUBLE), b0hi, b1hi FROM tot),
ob AS (SELECT cand.g, t, CASE WHEN n0 <> 0 THEN b0 / n0 ELSE 0.0 END AS tpr,
              CASE WHEN n1 <> 0 THEN b1 / n1 ELSE 0.0 END AS fpr, target_tpr, target_fpr
       FROM cand JOIN tot ON cand.g = tot.g, tgt),
best AS (SELECT g, t, """ + obj + """ AS objective,
                row_number() OVER (PARTITION BY g ORDER BY """ + obj + """, abs(t - 0.5), t) AS rn FROM ob),
th AS (SELECT g, t AS threshold, objective FROM best WHERE rn = 1
       UNION ALL SELECT 1, 0.5, CAST(NULL AS DOUBLE))"""


@register("threshold_baseline", with_(D) + """
SELECT g, CAST(count_if(y = 0 AND p < 0.5) AS BIGINT) AS tn, CAST(count_if(y = 0 AND p >= 0.5) AS BIGINT) AS fp,
       CAST(count_if(y = 1 AND p < 0.5) AS BIGINT) AS fn, CAST(count_if(y = 1 AND p >= 0.5) AS BIGINT) AS tp,
       round(CASE WHEN count_if(y = 0 AND p IS NOT NULL) <> 0
                  THEN count_if(y = 0 AND p < 0.5) / count_if(y = 0 AND p IS NOT NULL) ELSE 0 END, 6) AS tpr,
       round(CASE WHEN count_if(y = 1 AND p IS NOT NULL) <> 0
                  THEN count_if(y = 1 AND p < 0.5) / count_if(y = 1 AND p IS NOT NULL) ELSE 0 END, 6) AS fpr,
       CAST(0.5 AS DOUBLE) AS threshold
FROM d WHERE g IS NOT NULL GROUP BY g""", rows="H1")
def q_threshold_baseline(spark, sf):
    return th.threshold_baseline(decision_frame(spark, sf), DECISIONS)


def _shown(t):
    """Rounded for display only; the table that is applied keeps full precision."""
    return t.select("g", r6("threshold").alias("threshold"), r6("objective").alias("objective"))


@register("threshold_fit", with_(D, _threshold_sql("equal_opportunity")) +
          "\nSELECT g, round(threshold, 6) AS threshold, round(objective, 6) AS objective FROM th", rows="H2 F3")
def q_threshold_fit(spark, sf):
    return _shown(th.fit_thresholds(decision_frame(spark, sf), DECISIONS))


@register("threshold_fit_eodds", with_(D, _threshold_sql("equalized_odds")) +
          "\nSELECT g, round(threshold, 6) AS threshold, round(objective, 6) AS objective FROM th", rows="H3")
def q_threshold_fit_eodds(spark, sf):
    return _shown(th.fit_thresholds(decision_frame(spark, sf), DECISIONS, objective="equalized_odds"))


APPLY_SQL = """,
ap AS (SELECT d.*, CAST(d.p >= coalesce(th.threshold, 0.5) AS INTEGER) AS pred_adj,
              d.g IS NOT NULL AND th.threshold IS NOT NULL AS fairness_adjusted
       FROM d LEFT JOIN th ON d.g = th.g)"""


def _fitted(spark, sf):
    """Decision frame and its fitted threshold table (one row per group,
    evaluated once and reused by every branch of the plan)."""
    df = decision_frame(spark, sf)
    return df, write_once(th.fit_thresholds(df, DECISIONS), "thresholds")


@register("threshold_apply", with_(D, _threshold_sql("equal_opportunity")) + APPLY_SQL +
          "\nSELECT id, g, p, pred_adj, fairness_adjusted FROM ap", rows="H4 H6")
def q_threshold_apply(spark, sf):
    df, t = _fitted(spark, sf)
    return th.apply_thresholds(df, DECISIONS, t).select("id", "g", "p", "pred_adj", "fairness_adjusted")


@register("threshold_pipeline", with_(D, _threshold_sql("equal_opportunity")) + APPLY_SQL +
          "\nSELECT id, g, p, pred_adj, fairness_adjusted FROM ap", rows="H4 H6 S7")
def q_threshold_pipeline(spark, sf):
    """The thresholds as a stage of a fitted pipeline that is saved and read back."""
    from pyspark.ml import Pipeline, PipelineModel

    from ..operators.stages import GroupThresholds
    df, path = decision_frame(spark, sf), scratch_path(spark, "threshold-pipeline")
    Pipeline(stages=[GroupThresholds()]).fit(df).write().save(path)
    return PipelineModel.load(path).transform(df).select("id", "g", "p", "pred_adj", "fairness_adjusted")


@register("threshold_effect", with_(D, _threshold_sql("equal_opportunity")) + APPLY_SQL + """,
gc AS (SELECT g, CAST(count_if(y = 0 AND pred_adj = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND pred_adj = 1) AS BIGINT) AS fp,
              CAST(count_if(y = 1 AND pred_adj = 0) AS BIGINT) AS fn, CAST(count_if(y = 1 AND pred_adj = 1) AS BIGINT) AS tp
       FROM ap WHERE g IS NOT NULL GROUP BY g),
gr AS (SELECT *, CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0 END AS tpr,
                 CASE WHEN fn + tp <> 0 THEN fn / (fn + tp) ELSE 0 END AS fpr FROM gc)
SELECT g, tn, fp, fn, tp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr,
       round(abs(gr.tpr - (SELECT tpr FROM gr WHERE g = 1)), 6) AS tpr_gap FROM gr""", rows="H5")
def q_threshold_effect(spark, sf):
    df, t = _fitted(spark, sf)
    return th.threshold_effect(df, DECISIONS, t)


@register("score_decisions", with_(D, _threshold_sql("equal_opportunity")) + APPLY_SQL + """
SELECT id, pred_adj AS prediction,
       CASE WHEN pred_adj = 0 THEN 'Good Credit' ELSE 'Default Risk' END AS prediction_label,
       round(p, 6) AS probability_default, round(1 - p, 6) AS probability_good,
       CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level,
       fairness_adjusted, '1.0.0' AS model_version
FROM ap""", rows="O2 O4 O5")
def q_score_decisions(spark, sf):
    df, t = _fitted(spark, sf)
    return sc.score_decisions(df, DECISIONS, t)


@register("risk_tiers", with_(D) + """
SELECT CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level,
       CAST(count(*) AS BIGINT) AS n, CAST(count_if(y = 1) AS BIGINT) AS n_default, round(avg(p), 6) AS mean_score
FROM d GROUP BY 1""", rows="O3")
def q_risk_tiers(spark, sf):
    return sc.risk_tiers(decision_frame(spark, sf), DECISIONS)


@register("tier_mix", with_(D) + """,
t AS (SELECT g, CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level,
             CAST(count(*) AS BIGINT) AS n FROM d WHERE g IS NOT NULL GROUP BY 1, 2)
SELECT g, risk_level, n, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM t""", rows="O6")
def q_tier_mix(spark, sf):
    return sc.tier_mix(decision_frame(spark, sf), DECISIONS)


@register("reweighing_weights", with_(D, WEIGHTS_SQL) + """
SELECT c.g, c.y, CAST(c.n_gy AS BIGINT) AS n_gy, round(w.weight, 6) AS weight
FROM c JOIN w ON c.g = w.g AND c.y = w.y""", rows="R1")
def q_reweighing_weights(spark, sf):
    t = mg.reweighing_table(_train(spark, sf), DECISIONS)
    return t.select("g", "y", "n_gy", r6("weight").alias("weight"))


@register("stratum_counts", with_(D) + """
SELECT CAST(y AS VARCHAR) || '_' || CAST(g AS VARCHAR) AS stratum, CAST(count(*) AS BIGINT) AS n
FROM d GROUP BY 1""", rows="E14 T1")
def q_stratum_counts(spark, sf):
    from ..operators.encode import stratum_key
    return stratum_key(decision_frame(spark, sf), DECISIONS).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
