"""Classification performance.

Every function returns a lazy DataFrame with one row per ``by`` group (one row
overall when ``by`` is empty); many models or folds are scored in one job by
stacking them with a key column and passing it in ``by``.
Class 1 (unfavourable, default) is the positive class for precision, recall,
F1 and the ranking metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, r6, safe_div, wsum, zero_div
from ..functions.ranking import collapse_scores, running_totals
from ..session import write_once
from ..spec import AuditSpec

PERFORMANCE_COLS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score")


def _valid(spec: AuditSpec):
    return F.col(spec.label).isNotNull() & F.col(spec.pred).isNotNull()


def confusion_sums(spec: AuditSpec) -> list:
    y, yh, w = F.col(spec.label), F.col(spec.pred), spec.weight
    ok = _valid(spec)
    return [wsum(ok & (y == 0) & (yh == 0), w).alias("tn"),
            wsum(ok & (y == 0) & (yh == 1), w).alias("fp"),
            wsum(ok & (y == 1) & (yh == 0), w).alias("fn"),
            wsum(ok & (y == 1) & (yh == 1), w).alias("tp"),
            count_if(~ok).alias("n_excluded")]


def confusion(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp with label order [0, 1] (weighted when spec.weight),
    plus ``n_excluded`` rows with a NULL label or prediction."""
    return df.groupBy(*by).agg(*confusion_sums(spec))


def rates_from_confusion(cm: DataFrame, keep: Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """C2-C6 from confusion counts: accuracy, balanced accuracy (mean of the
    recalls that are defined), precision / recall / F1 (0 when undefined)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    rec1, rec0 = safe_div(tp, tp + fn), safe_div(tn, tn + fp)
    bal = F.when(rec1.isNotNull() & rec0.isNotNull(), (rec1 + rec0) / 2).otherwise(F.coalesce(rec1, rec0))
    shown = r6 if rounded else (lambda c: c)
    return cm.select(
        *keep,
        shown(safe_div(tp + tn, n)).alias("accuracy"),
        shown(bal).alias("balanced_accuracy"),
        shown(zero_div(tp, tp + fp)).alias("precision"),
        shown(zero_div(tp, tp + fn)).alias("recall"),
        shown(zero_div(2 * tp, 2 * tp + fp + fn)).alias("f1_score"),
    )


def performance(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """C2-C6 in one aggregate."""
    return rates_from_confusion(confusion(df, spec, by), keep=by)


def cells(df: DataFrame, spec: AuditSpec, by: Sequence[str], cols: Sequence[str | None]) -> tuple[DataFrame, AuditSpec]:
    """The rows collapsed to one row for each ``by`` key and combination of ``cols`` with its count (or sum of weights),
    written once, and the spec that reads it: whatever a report needs comes from this table, so the rows themselves
    are read once."""
    names = list(dict.fromkeys([*by, *[c for c in cols if c is not None]]))
    total = F.sum(spec.weight) if spec.weight else F.count(F.lit(1))
    return write_once(df.groupBy(*names).agg(total.alias("_cell")), "cells"), spec.with_(weight="_cell")


def ranking_metrics(df: DataFrame, spec: AuditSpec, by: Sequence[str] = (), rounded: bool = True) -> DataFrame:
    """C7 ROC-AUC (ties count one half) and C8 average precision (step sum).

    Scores collapse to distinct values per ``by`` key first, then running
    counts in descending score order come from the two-level prefix sum, so
    no task holds more than one range bucket of distinct scores.
    AUC = sum(neg * (cum_pos - pos / 2)) / (P * N);
    AP  = sum(pos * cum_pos / (cum_pos + cum_neg)) / P.
    NULL when a class is absent.
    """
    coll = collapse_scores(df, spec.score, spec.label, by, spec.weight)
    run = running_totals(coll, by, "s", ["pos", "neg"], descending=True)
    agg = run.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)).alias("_auc_num"),
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_ap_num"),
    )
    shown = r6 if rounded else (lambda c: c)
    return agg.select(
        *by,
        shown(F.when((F.col("P") > 0) & (F.col("N") > 0),
                     F.col("_auc_num") / (F.col("P").cast("double") * F.col("N")))).alias("roc_auc"),
        shown(safe_div(F.col("_ap_num"), F.col("P"))).alias("average_precision"),
    )


def performance_full(df: DataFrame, spec: AuditSpec, by: Sequence[str] = ()) -> DataFrame:
    """C2-C6 plus score metrics, from one pass over the rows; score metrics are NULL without a score."""
    if spec.score is not None:
        df, spec = cells(df, spec, by, (spec.label, spec.pred, spec.score))
    perf = performance(df, spec, by)
    if spec.score is None:
        return perf.withColumn("roc_auc", F.lit(None).cast("double")) \
                   .withColumn("average_precision", F.lit(None).cast("double"))
    rk = ranking_metrics(df, spec, by)
    return join_rows(perf, rk, by, "left")


def join_rows(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two per-key result tables; with no key both are single rows, joined
    on a constant key (one row each, never a product of data rows)."""
    if by:
        return a.join(b, list(by), how)
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", how).drop("_one")


def group_confusion(df: DataFrame, spec: AuditSpec, pred_col: str | None = None) -> DataFrame:
    """Per-group confusion counts and the favourable-class rates used by
    the threshold module: ``tpr`` = tn/(tn+fp), ``fpr`` = fn/(fn+tp), 0 when empty."""
    s = spec if pred_col is None else spec.with_(pred=pred_col)
    cm = confusion(df.where(F.col(spec.group).isNotNull()), s, [spec.group])
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.select(spec.group, "tn", "fp", "fn", "tp",
                     r6(zero_div(tn, tn + fp)).alias("tpr"),
                     r6(zero_div(fn, fn + tp)).alias("fpr"))
