"""Golden values and properties of the performance and fairness metrics."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from equilens.operators import fairness as fm
from equilens.operators import metrics as mt
from equilens.spec import AuditSpec

SPEC = AuditSpec()


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, g int, p double, pred int")


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def brute_ap(ys, ps):
    P = sum(ys)
    ap = 0.0
    for t in sorted(set(ps), reverse=True):
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        pos_at = sum(1 for y, p in zip(ys, ps) if p == t and y == 1)
        ap += pos_at / P * tp / (tp + fp)
    return ap


def test_confusion_and_rates(spark):
    rows = [(1, 0, 1, .1, 0), (2, 0, 1, .7, 1), (3, 1, 0, .8, 1), (4, 1, 0, .2, 0), (5, 1, 1, .9, 1),
            (6, 0, 0, .4, 0), (7, 0, 0, .45, 0), (8, None, 1, .5, 1)]
    df = frame(spark, rows)
    cm = mt.confusion(df, SPEC).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp, cm.n_excluded) == (3, 1, 1, 2, 1)
    r = mt.performance(df, SPEC).first()
    assert r.accuracy == round(5 / 7, 6)
    assert r.precision == round(2 / 3, 6) and r.recall == round(2 / 3, 6)
    assert r.balanced_accuracy == round((2 / 3 + 3 / 4) / 2, 6)
    assert r.f1_score == round(4 / 6, 6)


def test_zero_division_conventions(spark):
    df = frame(spark, [(1, 0, 1, .1, 0), (2, 0, 0, .2, 0)])
    r = mt.performance_full(df, SPEC).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1_score == 0.0
    assert r.balanced_accuracy == 1.0          # only the defined recall counts
    assert r.roc_auc is None                    # one class only


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranking_metrics_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, 1), rnd.choice([.1, .2, .3, .5, .5, .7, .9]), 0) for i in range(60)]
    ys, ps = [r[1] for r in rows], [r[3] for r in rows]
    got = mt.ranking_metrics(frame(spark, rows), SPEC).first()
    assert got.roc_auc == pytest.approx(brute_auc(ys, ps), abs=1e-6)
    assert got.average_precision == pytest.approx(brute_ap(ys, ps), abs=1e-6)
    flipped = frame(spark, [(i, y, g, 1 - p, d) for i, y, g, p, d in rows])
    assert mt.ranking_metrics(flipped, SPEC).first().roc_auc == pytest.approx(1 - got.roc_auc, abs=2e-6)


def test_ranking_by_key_equals_separate(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 1), i % 2, round(rnd.random(), 2), 0) for i in range(200)]
    df = frame(spark, rows).withColumn("k", F.col("id") % 3)
    by = {r.k: r.roc_auc for r in mt.ranking_metrics(df, SPEC, ["k"]).collect()}
    for k in range(3):
        sub = [r for r in rows if r[0] % 3 == k]
        assert by[k] == pytest.approx(brute_auc([r[1] for r in sub], [r[3] for r in sub]), abs=1e-6)


def test_parity_anchor(spark):
    # whole-data approval rates 201/310 (female, g=0) and 499/690 (male, g=1): DI 0.897
    rows = ([(i, 0, 0, .1, 0) for i in range(201)] + [(1000 + i, 1, 0, .9, 1) for i in range(109)] +
            [(2000 + i, 0, 1, .1, 0) for i in range(499)] + [(3000 + i, 1, 1, .9, 1) for i in range(191)])
    r = fm.label_parity(frame(spark, rows), SPEC).first()
    assert round(r.disparate_impact, 3) == 0.897
    assert round(r.statistical_parity_difference * 100, 1) == -7.5


def test_equal_opportunity_empty_side_is_zero(spark):
    rows = [(1, 0, 1, .1, 0), (2, 0, 1, .9, 1), (3, 1, 0, .9, 1)]
    r = fm.equal_opportunity(frame(spark, rows), SPEC).first()
    assert r.equal_opportunity_difference == -0.5


def test_composite_reproduces_published_score(spark):
    df = spark.createDataFrame([(0.72619, 0.61429, 0.83952, 0.89032, -0.07948)], "b double, f double, a double, d double, s double")
    v = df.select(fm.composite_col(F.col("b"), F.col("f"), F.col("a"), F.col("d"), F.col("s")).alias("c")).first().c
    assert round(v, 5) == 0.78482


def test_status_and_null_di(spark):
    rows = [(1, 0, 0, .1, 0), (2, 1, 1, .9, 1)]   # privileged favourable rate 0 -> DI undefined
    st = {r.metric: r.passed for r in fm.fairness_status(frame(spark, rows), SPEC).collect()}
    assert st["disparate_impact"] is False


def test_model_comparison_is_one_grouped_job(spark):
    rows = [(i, i % 2, (i // 2) % 2, (i % 10) / 10, int((i % 10) >= 5)) for i in range(100)]
    df = frame(spark, rows)
    stacked = df.select(F.lit("a").alias("model"), "*").unionByName(df.select(F.lit("b").alias("model"), "*"))
    rep = fm.fairness_report(stacked, SPEC, ["model"]).collect()
    one = fm.fairness_report(df, SPEC).first()
    assert len(rep) == 2 and all(r.composite_score == one.composite_score for r in rep)


def test_weighted_ranking_equals_duplicated_rows(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, 1), rnd.choice([.1, .3, .5, .7, .9]), rnd.randint(1, 3))
            for i in range(80)]
    w = spark.createDataFrame(rows, "id long, y int, g int, p double, w int").withColumn("w", F.col("w").cast("double"))
    dup = spark.createDataFrame([(r[0] * 10 + k, r[1], r[2], r[3], 0) for r in rows for k in range(r[4])],
                                "id long, y int, g int, p double, pred int")
    a = mt.ranking_metrics(w, SPEC.with_(weight="w")).first()
    b = mt.ranking_metrics(dup, SPEC).first()
    assert a.roc_auc == pytest.approx(b.roc_auc, abs=1e-6)
    assert a.average_precision == pytest.approx(b.average_precision, abs=1e-6)
