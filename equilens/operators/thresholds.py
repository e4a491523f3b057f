"""Group-specific decision thresholds (H1-H6).

The predicted label is ``p >= threshold``. The privileged group keeps 0.5;
every other group gets the threshold in [0.1, 0.9] that brings its
favourable-class TPR (tn / (tn + fp): share of good rows predicted good) as
close as possible to the privileged TPR at 0.5 (equal opportunity), or that
minimises |dTPR| + |dFPR| (equalized odds).

Instead of a bounded scalar search on a step function, the sweep is exact:
the TPR only changes at observed scores, so the candidates are the distinct
scores in range plus the upper bound. Counts below each candidate come from
the two-level prefix sum over (group, distinct score), never from a window
over all rows. Ties in the objective go to the threshold nearest 0.5, then
the smaller one. The fitted table keeps full precision: the decision is ``p >= t``
at an observed score, so a rounded threshold would flip the rows at it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import r6, zero_div
from ..functions.ranking import running_totals
from ..spec import DEFAULT_CUT, THRESHOLD_BOUNDS, AuditSpec
from .metrics import group_confusion


def threshold_baseline(df: DataFrame, spec: AuditSpec, cut: float = DEFAULT_CUT) -> DataFrame:
    """H1: per-group confusion and rates at the default cut."""
    d = df.withColumn("_pred_cut", (F.col(spec.score) >= F.lit(cut)).cast("int"))
    return group_confusion(d, spec, "_pred_cut").withColumn("threshold", F.lit(cut))


def fit_thresholds(df: DataFrame, spec: AuditSpec, objective: str = "equal_opportunity",
                   bounds: tuple[float, float] = THRESHOLD_BOUNDS) -> DataFrame:
    """H2 / H3: table (group, threshold, objective) with the privileged group at 0.5."""
    if objective not in ("equal_opportunity", "equalized_odds"):
        raise ValueError(f"unknown objective {objective}")
    g, y, p = F.col(spec.group), F.col(spec.label), F.col(spec.score)
    fav = F.lit(spec.favorable)
    base = df.where(g.isNotNull() & y.isNotNull() & p.isNotNull())
    # one collapse of all groups (the only pass over the rows); every later
    # table reads the checkpointed running totals
    coll = base.groupBy(F.col(spec.group).alias("grp"), F.col(spec.score).alias("s")).agg(
        F.sum(F.when(y == fav, 1).otherwise(0)).cast("bigint").alias("c0"),
        F.sum(F.when(y != fav, 1).otherwise(0)).cast("bigint").alias("c1"))
    run = running_totals(coll, ["grp"], "s", ["c0", "c1"], descending=False)
    priv = F.col("grp") == F.lit(spec.privileged)
    # privileged rates at the default cut: share of good rows predicted good, of bad rows predicted good
    tgt = run.where(priv).agg(
        F.sum("c0").alias("_pn0"), F.sum(F.when(F.col("s") < DEFAULT_CUT, F.col("c0")).otherwise(0)).alias("_pb0"),
        F.sum("c1").alias("_pn1"), F.sum(F.when(F.col("s") < DEFAULT_CUT, F.col("c1")).otherwise(0)).alias("_pb1"),
    ).select(F.when(F.col("_pn0") != 0, F.col("_pb0") / F.col("_pn0")).otherwise(0.0).alias("target_tpr"),
             F.when(F.col("_pn1") != 0, F.col("_pb1") / F.col("_pn1")).otherwise(0.0).alias("target_fpr"))
    run = run.where(~priv)
    lo, hi = bounds
    in_range = (F.col("s") >= lo) & (F.col("s") <= hi)
    if objective == "equal_opportunity":
        in_range = in_range & (F.col("c0") > 0)
    cand = run.where(in_range).select(
        "grp", F.col("s").alias("t"), (F.col("cum_c0") - F.col("c0")).alias("b0"),
        (F.col("cum_c1") - F.col("c1")).alias("b1"))
    tot = run.groupBy("grp").agg(
        F.sum("c0").alias("n0"), F.sum("c1").alias("n1"),
        F.sum(F.when(F.col("s") < hi, F.col("c0")).otherwise(0)).alias("_b0hi"),
        F.sum(F.when(F.col("s") < hi, F.col("c1")).otherwise(0)).alias("_b1hi"))
    upper = tot.select("grp", F.lit(float(hi)).alias("t"), F.col("_b0hi").alias("b0"), F.col("_b1hi").alias("b1"))
    cands = cand.unionByName(upper).join(tot.select("grp", "n0", "n1"), "grp")
    # one target row: a proven broadcast
    cands = cands.withColumn("_one", F.lit(1)).join(F.broadcast(tgt.withColumn("_one", F.lit(1))), "_one")
    tpr = F.when(F.col("n0") != 0, F.col("b0") / F.col("n0")).otherwise(0.0)
    fpr = F.when(F.col("n1") != 0, F.col("b1") / F.col("n1")).otherwise(0.0)
    obj = F.abs(tpr - F.col("target_tpr"))
    if objective == "equalized_odds":
        obj = obj + F.abs(fpr - F.col("target_fpr"))
    scored = cands.select("grp", "t", obj.alias("obj"))
    best = scored.groupBy("grp").agg(
        F.min(F.struct(F.col("obj"), F.abs(F.col("t") - DEFAULT_CUT).alias("dist"), F.col("t"))).alias("b"))
    fitted = best.select(F.col("grp").alias(spec.group), F.col("b.t").alias("threshold"), F.col("b.obj").alias("objective"))
    privileged = df.sparkSession.range(1).select(
        F.lit(spec.privileged).cast(df.schema[spec.group].dataType).alias(spec.group),
        F.lit(DEFAULT_CUT).alias("threshold"), F.lit(None).cast("double").alias("objective"))
    return fitted.unionByName(privileged)


def apply_thresholds(df: DataFrame, spec: AuditSpec, thresholds: DataFrame | None,
                     out: str = "pred_adj", flag: str = "fairness_adjusted") -> DataFrame:
    """H4 / H6: predicted label with the group's threshold when the group is
    known and fitted, else the default cut; ``fairness_adjusted`` tells which.
    The threshold table has one row per group; AQE broadcasts it."""
    if thresholds is None:
        return df.withColumn(out, (F.col(spec.score) >= DEFAULT_CUT).cast("int")).withColumn(flag, F.lit(False))
    t = thresholds.select(F.col(spec.group).alias("_tg"), F.col("threshold").alias("_t"))
    j = df.join(t, F.col(spec.group) == F.col("_tg"), "left")
    adjusted = F.col(spec.group).isNotNull() & F.col("_t").isNotNull()
    return j.withColumn(out, (F.col(spec.score) >= F.coalesce(F.col("_t"), F.lit(DEFAULT_CUT))).cast("int")) \
            .withColumn(flag, adjusted).drop("_tg", "_t")


def threshold_effect(df: DataFrame, spec: AuditSpec, thresholds: DataFrame) -> DataFrame:
    """H5: per-group rates after the thresholds, with the residual TPR gap to
    the privileged group."""
    from pyspark.sql import Window
    adj = apply_thresholds(df, spec, thresholds)
    gc = group_confusion(adj, spec, "pred_adj")
    # the privileged rate is read from the same grouped table (one row per
    # group) by a window over it, not by a second aggregate of the data
    tpr = zero_div(F.col("tn"), F.col("tn") + F.col("fp"))   # unrounded
    ref = F.max(F.when(F.col(spec.group) == F.lit(spec.privileged), tpr)).over(Window.partitionBy())
    return gc.select(spec.group, "tn", "fp", "fn", "tp", "tpr", "fpr", r6(F.abs(tpr - ref)).alias("tpr_gap"))
