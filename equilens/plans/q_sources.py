"""Registered queries: table round trips and stored reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as fm
from ..operators import mitigate as mg
from ..session import scratch_path
from ..sources import store
from ..sources.frames import decision_frame
from ..spec import DECISIONS
from .q_metrics import CM, PAR, RANK
from .q_mitigate import EXACT_SQL
from .registry import register
from .sqlframes import DECISIONS as D, with_

DECISION_DDL = ("id BIGINT, y INT, g INT, segment STRING, region STRING, nation STRING, priority STRING, "
                "price_band STRING, o_totalprice DOUBLE, c_acctbal DOUBLE, p DOUBLE, pred INT")


@register("scan_decisions", with_(D) + """
SELECT id, y, g, segment, region, nation, priority, price_band, o_totalprice, c_acctbal, p, pred FROM d""",
          rows="S2 S3")
def q_scan_decisions(spark, sf):
    """Hand-over of the analysis table as headered CSV, read back with an
    explicit schema (no inference)."""
    path = scratch_path(spark, "decisions-csv")
    cols = [c.split()[0] for c in DECISION_DDL.split(", ")]
    store.write_table(decision_frame(spark, sf).select(*cols), path, fmt="csv")
    return store.read_table_at(spark, path, fmt="csv", schema=DECISION_DDL)


@register("split_roundtrip", with_(D, EXACT_SQL) + "SELECT id, y, g, split FROM hs", rows="S4 S5")
def q_split_roundtrip(spark, sf):
    path = scratch_path(spark, "split")
    df = mg.holdout_exact(decision_frame(spark, sf), DECISIONS).select("id", "y", "g", "o_totalprice", "split")
    store.save_split(df, path, DECISIONS, ["o_totalprice"])
    both = store.load_split(spark, path, "train").unionByName(store.load_split(spark, path, "test"))
    return both.select("id", "y", "g", F.col("split").cast("string").alias("split"))


@register("model_report", with_(D, CM, RANK, PAR) + """,
perf AS (SELECT * FROM cm, rk),
r AS (SELECT
  round(CASE WHEN tn + fp + fn + tp <> 0 THEN CAST(tp + tn AS DOUBLE) / CAST(tn + fp + fn + tp AS DOUBLE) END, 6) AS accuracy,
  round(CASE WHEN tp + fn <> 0 AND tn + fp <> 0
             THEN (CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) + CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE)) / 2
             WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE)
             WHEN tn + fp <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn <> 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END, 6) AS f1_score,
  roc_auc, disparate_impact, statistical_parity_difference,
  coalesce(disparate_impact >= 0.8 AND disparate_impact <= 1.25, false)
    AND coalesce(abs(statistical_parity_difference) <= 0.1, false) AS fairness_compliant
  FROM perf, fm)
SELECT * FROM r""", rows="S7 S10 S12")
def q_model_report(spark, sf):
    path = scratch_path(spark, "bundle")
    store.save_bundle(path, report=fm.fairness_report(decision_frame(spark, sf), DECISIONS))
    return store.model_report(spark, path)
