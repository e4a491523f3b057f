"""Edge-case frames (FIXTURES section 10)."""

import pytest
from pyspark.sql import functions as F

from equilens.functions.exprs import right_closed_bins
from equilens.operators import fairness as fm
from equilens.operators import metrics as mt
from equilens.operators import prep as pp
from equilens.operators.scoring import risk_tier
from equilens.spec import AGE_BIN_EDGES, AGE_BIN_LABELS, AuditSpec

SPEC = AuditSpec()


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, g int, p double, pred int")


def test_all_scores_equal_auc_half(spark):
    df = frame(spark, [(i, i % 2, i % 2, 0.5, 1) for i in range(10)])
    r = mt.ranking_metrics(df, SPEC).first()
    assert r.roc_auc == 0.5 and r.average_precision == 0.5


def test_tier_boundaries_and_default_cut(spark):
    df = spark.createDataFrame([(0.3,), (0.6,), (0.2999,), (0.5,)], "p double")
    tiers = [r.t for r in df.select(risk_tier("p").alias("t")).collect()]
    assert tiers == ["Medium", "High", "Low", "Medium"]


def test_age_bins_right_closed(spark):
    df = spark.createDataFrame([(18,), (19,), (25,), (26,), (100,), (101,)], "age int")
    got = [r.b for r in df.select(right_closed_bins("age", AGE_BIN_EDGES, AGE_BIN_LABELS).alias("b")).collect()]
    assert got == [None, "18-25", "18-25", "26-35", "55+", None]


def test_null_group_and_label_excluded_and_counted(spark):
    rows = [(1, 0, 1, .1, 0), (2, 1, 0, .9, 1), (3, None, 1, .2, 0), (4, 0, None, .3, 0)]
    df = frame(spark, rows)
    assert mt.confusion(df, SPEC).first().n_excluded == 1
    gc = {r.g: r for r in mt.group_confusion(df, SPEC).collect()}
    assert set(gc) == {0, 1}


def test_group_outside_binary_is_unprivileged(spark):
    rows = [(1, 0, 1, .1, 0), (2, 0, 2, .1, 0), (3, 1, 2, .9, 1), (4, 0, 1, .2, 0)]
    r = fm.label_parity(frame(spark, rows), SPEC).first()
    assert r.favorable_rate_unprivileged == 0.5 and r.favorable_rate_privileged == 1.0


def test_privileged_rate_zero_gives_null_di(spark):
    rows = [(1, 1, 1, .9, 1), (2, 0, 0, .1, 0)]
    r = fm.label_parity(frame(spark, rows), SPEC).first()
    assert r.disparate_impact is None and r.statistical_parity_difference == 1.0


def test_one_group_empty(spark):
    rows = [(1, 0, 1, .1, 0), (2, 1, 1, .9, 1)]
    r = fm.fairness_metrics(frame(spark, rows), SPEC).first()
    assert r.disparate_impact is None and r.statistical_parity_difference is None
    assert r.equal_opportunity_difference == -1.0      # empty side counts 0


def test_weight_zero_rows_do_not_count(spark):
    df = frame(spark, [(1, 0, 1, .1, 0), (2, 0, 0, .9, 1), (3, 1, 0, .2, 0)]) \
        .withColumn("w", F.when(F.col("id") == 3, 0.0).otherwise(1.0))
    r = fm.label_parity(df, SPEC.with_(weight="w")).first()
    assert r.favorable_rate_unprivileged == 1.0


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, None), (3, 5.0, None)], "id long, c double, n double")
    p = pp.Preprocessor(["c", "n"]).fit(df)
    out = p.transform(df).collect()
    assert all(r.c == 0.0 for r in out)                # constant column divides by 1
    assert all(r.n is None for r in out)               # nothing to impute from


def test_unseen_category_code(spark):
    from equilens.operators.encode import code_dictionary, dictionary_frame
    df = spark.createDataFrame([("A",), ("A",), ("B",)], "c string")
    d = dictionary_frame(spark, [("A", "alpha"), ("B", "beta"), ("Z", "unused")], ["code", "meaning"])
    got = {r.code: r.n for r in code_dictionary(df, "c", d).collect()}
    assert got == {"A": 2, "B": 1, "Z": 0}


def test_scores_exactly_at_cut_predict_positive(spark):
    from equilens.operators.thresholds import apply_thresholds
    df = frame(spark, [(1, 0, 1, 0.5, 0), (2, 0, 0, 0.4, 0)])
    t = spark.createDataFrame([(0, 0.4), (1, 0.5)], "g int, threshold double")
    assert {r.id: r.pred_adj for r in apply_thresholds(df, SPEC, t).collect()} == {1: 1, 2: 1}
