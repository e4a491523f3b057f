"""Search history analysis (K1-K6, L9, L11) over a history table
(trial, model_type, score, params). The table has one row per trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6


def top_trials(hist: DataFrame, k: int = 5) -> DataFrame:
    """K1: the k best trials (score desc, then trial) - a top-k report, so the
    limit is the feature (planned as TakeOrderedAndProject)."""
    return hist.orderBy(F.col("score").desc(), F.col("trial").asc()).limit(k) \
               .select("trial", "model_type", "score")


def best_trial(hist: DataFrame) -> DataFrame:
    """The trial with the highest score (ties: lowest trial number)."""
    b = hist.agg(F.max(F.struct(F.col("score"), (-F.col("trial")).alias("neg_trial"), F.col("model_type"),
                                F.col("params"))).alias("b"))
    return b.select((-F.col("b.neg_trial")).cast("int").alias("trial"), F.col("b.model_type").alias("model_type"),
                    F.col("b.score").alias("score"), F.col("b.params").alias("params"))


def family_stats(hist: DataFrame) -> DataFrame:
    """K3: mean, max and count of scores per model family."""
    return hist.groupBy("model_type").agg(r6(F.avg("score")).alias("mean_score"), r6(F.max("score")).alias("max_score"),
                                          F.count(F.lit(1)).alias("n_trials"))


def family_counts(hist: DataFrame) -> DataFrame:
    """K4: trials per family."""
    return hist.groupBy("model_type").agg(F.count(F.lit(1)).alias("n_trials"))


def score_progress(hist: DataFrame) -> DataFrame:
    """K5: score by trial number and the running best. The history has one
    row per trial (bounded by the search budget), so an ordered window over it
    is small."""
    w = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.select("trial", "score", F.max("score").over(w).alias("best_so_far"))
