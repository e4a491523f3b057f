"""Group fairness metrics and decisions.

All metrics are ratios of conditional sums, computed in a single aggregate
(algebraic: partial sums per partition, then a final merge), so skewed groups
cost nothing extra. The favourable outcome is ``spec.favorable`` (0 = good).

Two parity flavours (SURVEY Q1): the audited pipeline measures disparate
impact and statistical parity on the *true label*; ``label_parity`` keeps that
meaning, ``prediction_parity`` measures the same on the decision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, r6, safe_div, wsum
from ..spec import (DISPARATE_IMPACT_THRESHOLD, FAIRNESS_WEIGHT, STATISTICAL_PARITY_THRESHOLD,
                    EQUAL_OPPORTUNITY_THRESHOLD, AuditSpec)
from .metrics import join_rows

FAIRNESS_COLS = ("disparate_impact", "statistical_parity_difference", "equal_opportunity_difference")


def _sides(spec: AuditSpec):
    g = F.col(spec.group)
    priv = g == F.lit(spec.privileged)
    unpriv = g.isNotNull() & (g != F.lit(spec.privileged))
    return priv, unpriv


def parity_sums(spec: AuditSpec, outcome: str, tag: str = "") -> list[Column]:
    """Conditional sums for DI / SPD on ``outcome`` (weighted when spec.weight)."""
    priv, unpriv = _sides(spec)
    fav = F.col(outcome) == F.lit(spec.favorable)
    ok = F.col(outcome).isNotNull()
    w = spec.weight
    return [wsum(ok & unpriv, w).alias(f"_n_u{tag}"), wsum(ok & unpriv & fav, w).alias(f"_f_u{tag}"),
            wsum(ok & priv, w).alias(f"_n_p{tag}"), wsum(ok & priv & fav, w).alias(f"_f_p{tag}")]


def parity_cols(prefix: str = "", tag: str = "", rounded: bool = True) -> list[Column]:
    """DI = rate_u / rate_p (NULL when rate_p is 0 or undefined), SPD = rate_u - rate_p."""
    ru = safe_div(F.col(f"_f_u{tag}"), F.col(f"_n_u{tag}"))
    rp = safe_div(F.col(f"_f_p{tag}"), F.col(f"_n_p{tag}"))
    shown = r6 if rounded else (lambda c: c)
    return [shown(ru).alias(f"{prefix}favorable_rate_unprivileged"),
            shown(rp).alias(f"{prefix}favorable_rate_privileged"),
            shown(safe_div(ru, rp)).alias(f"{prefix}disparate_impact"),
            shown(ru - rp).alias(f"{prefix}statistical_parity_difference")]


def parity(df: DataFrame, spec: AuditSpec, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """M1 + M2 on the given outcome column."""
    return df.groupBy(*by).agg(*parity_sums(spec, outcome)).select(*by, *parity_cols())


def label_parity(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    return parity(df, spec, spec.label, by)


def prediction_parity(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    return parity(df, spec, spec.pred, by)


def eod_sums(spec: AuditSpec) -> list[Column]:
    priv, unpriv = _sides(spec)
    y, yh = F.col(spec.label), F.col(spec.pred)
    base = (y == F.lit(spec.favorable)) & yh.isNotNull()
    hit = yh == F.lit(spec.favorable)
    w = spec.weight
    return [wsum(base & unpriv, w).alias("_e_nu"), wsum(base & unpriv & hit, w).alias("_e_hu"),
            wsum(base & priv, w).alias("_e_np"), wsum(base & priv & hit, w).alias("_e_hp")]


def eod_col(rounded: bool = True) -> Column:
    """M3: P(pred=fav | y=fav, unpriv) - P(pred=fav | y=fav, priv); an empty side counts 0."""
    tu = F.coalesce(safe_div(F.col("_e_hu"), F.col("_e_nu")), F.lit(0.0))
    tp = F.coalesce(safe_div(F.col("_e_hp"), F.col("_e_np")), F.lit(0.0))
    return (r6(tu - tp) if rounded else tu - tp).alias("equal_opportunity_difference")


def equal_opportunity(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*eod_sums(spec)).select(*by, eod_col())


def fairness_metrics(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """M4: DI and SPD on the label (as reported by the audited pipeline), EOD on
    the decision, plus the prediction-based DI / SPD, from one aggregate."""
    agg = df.groupBy(*by).agg(*parity_sums(spec, spec.label), *eod_sums(spec),
                              *parity_sums(spec, spec.pred, "_pr"))
    return agg.select(*by, *parity_cols(rounded=rounded)[2:], eod_col(rounded), *parity_cols("prediction_", "_pr", rounded)[2:])


def _di_pass(v: Column) -> Column:
    return (v >= DISPARATE_IMPACT_THRESHOLD) & (v <= 1.0 / DISPARATE_IMPACT_THRESHOLD)


def status_cols() -> list[Column]:
    """M5/M6 on a row holding the three metrics. A NULL metric fails."""
    di, spd, eod = (F.col(c) for c in FAIRNESS_COLS)
    di_ok = F.coalesce(_di_pass(di), F.lit(False))
    spd_ok = F.coalesce(F.abs(spd) <= STATISTICAL_PARITY_THRESHOLD, F.lit(False))
    eod_ok = F.coalesce(F.abs(eod) <= EQUAL_OPPORTUNITY_THRESHOLD, F.lit(False))
    return [di_ok.alias("di_pass"), spd_ok.alias("spd_pass"), eod_ok.alias("eod_pass"),
            (di_ok & spd_ok).alias("parity_compliant"), (di_ok & spd_ok & eod_ok).alias("all_fair")]


def fairness_status(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """M5 long form: one row per (metric) with value, threshold band and pass flag;
    the M6 verdicts are ``all_fair`` / ``parity_compliant`` columns."""
    fm = fairness_metrics(df, spec, by, rounded=False)   # compared as they are, rounded when shown
    wide = fm.select(*by, *FAIRNESS_COLS, *status_cols())
    long = wide.select(*by, "all_fair", "parity_compliant", F.explode(F.array(
        F.struct(F.lit("disparate_impact").alias("metric"), F.col("disparate_impact").alias("value"),
                 F.col("di_pass").alias("pass")),
        F.struct(F.lit("statistical_parity_difference").alias("metric"),
                 F.col("statistical_parity_difference").alias("value"), F.col("spd_pass").alias("pass")),
        F.struct(F.lit("equal_opportunity_difference").alias("metric"),
                 F.col("equal_opportunity_difference").alias("value"), F.col("eod_pass").alias("pass")),
    )).alias("m"))
    return long.select(*by, "m.metric", r6("m.value").alias("value"), F.col("m.pass").alias("passed"), "all_fair",
                       "parity_compliant")


def composite_col(bal: Column, f1: Column, auc: Column, di: Column, spd: Column,
                  weight: float = FAIRNESS_WEIGHT) -> Column:
    """M7: (1-w) * mean(bal_acc, f1, auc or 0.5) + w * (1 - max(0, 0.8 - DI) - |SPD|).
    A NULL DI (privileged favourable rate 0) gives no DI penalty, as an infinite
    ratio would."""
    perf = (bal + f1 + F.coalesce(auc, F.lit(0.5))) / 3.0
    di_pen = F.when(di < DISPARATE_IMPACT_THRESHOLD, F.lit(DISPARATE_IMPACT_THRESHOLD) - di).otherwise(0.0)
    fair = F.lit(1.0) - (di_pen + F.abs(spd))
    return (1 - weight) * perf + weight * fair


def fairness_report(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), parity_on: str | None = None,
                    rounded: bool = True) -> DataFrame:
    """M8 (and M9 with ``by=['model']``): performance, fairness, pass/fail and
    the composite score, one row per key. All metrics for all models come from
    grouped aggregates of one stacked table; nothing is collected per model.
    Parity is measured on the label, or on ``parity_on`` (the decision, when
    models compete). Verdicts and the score use unrounded values."""
    # with a score, the counts and the ranking metrics come from one collapse of the rows
    from .metrics import cells, confusion_sums, ranking_metrics, rates_from_confusion
    if spec.score is not None:
        df, spec = cells(df, spec, by, (spec.label, spec.group, spec.pred, parity_on, spec.score))
    agg = df.groupBy(*by).agg(*confusion_sums(spec), *parity_sums(spec, parity_on or spec.label), *eod_sums(spec),
                              *parity_sums(spec, spec.pred, "_pr"))
    both = rates_from_confusion(agg, keep=[*by, *[c for c in agg.columns if c.startswith("_")]], rounded=False)
    both = both.select(*by, "accuracy", "balanced_accuracy", "precision", "recall", "f1_score",
                       *parity_cols(rounded=False)[2:], eod_col(False), *parity_cols("prediction_", "_pr", False)[2:])
    if spec.score is None:
        rk = agg.select(*by, F.lit(None).cast("double").alias("roc_auc"),
                        F.lit(None).cast("double").alias("average_precision"))
    else:
        rk = ranking_metrics(df, spec, by, rounded=False)
    rep = join_rows(both, rk, by, "left")
    values = ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc", "average_precision",
              *FAIRNESS_COLS, "prediction_disparate_impact", "prediction_statistical_parity_difference")
    score = composite_col(F.col("balanced_accuracy"), F.col("f1_score"), F.col("roc_auc"),
                          F.col("disparate_impact"), F.col("statistical_parity_difference"))
    shown = r6 if rounded else F.col
    return rep.select(*by, *[shown(c).alias(c) for c in values], *status_cols(),
                      (r6(score) if rounded else score).alias("composite_score"))


def parity_by_group(df: DataFrame, group: str, outcome: str, reference: str | int,
                    favorable: int = 0, weight: str | None = None) -> DataFrame:
    """Each value of ``group`` against a reference value: favourable rate,
    ratio and difference to the reference rate. The reference rate is a
    conditional sum in the same grouped table (no second scan)."""
    fav = F.col(outcome) == F.lit(favorable)
    ok = F.col(outcome).isNotNull() & F.col(group).isNotNull()
    per = df.where(ok).groupBy(group).agg(
        count_if(F.lit(True)).alias("n"),
        wsum(fav, weight).alias("_fav"),
        (wsum(F.lit(True), weight) if weight else count_if(F.lit(True))).alias("_tot"))
    per = per.withColumn("favorable_rate", safe_div(F.col("_fav"), F.col("_tot")))
    # the reference row is one row of the grouped table: a proven one-row broadcast
    ref = F.broadcast(per.where(F.col(group) == F.lit(reference))
                         .select(F.col("favorable_rate").alias("_ref")))
    return join_rows(per, ref, ()).select(
        group, "n", r6("favorable_rate").alias("favorable_rate"),
        r6(safe_div(F.col("favorable_rate"), F.col("_ref"))).alias("disparate_impact"),
        r6(F.col("favorable_rate") - F.col("_ref")).alias("statistical_parity_difference"))
