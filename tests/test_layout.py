"""Running totals on fixed bucket edges; one pass over the rows for a whole report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.functions import ranking as rk
from equilens.operators.fairness import fairness_report
from equilens.operators.metrics import performance_full
from equilens.spec import AuditSpec


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    n = 3000
    s = np.round(rng.beta(0.3, 4, n), 4)   # crowded near 0
    return spark.createDataFrame([(i, int(rng.random() < v), i % 2, float(v), int(v >= 0.5), "ab"[i % 3 == 0], float(1 + i % 4)) for i, v in enumerate(s)],
                                 "id long, y int, g int, p double, pred int, m string, w double").repartition(6)


@pytest.mark.parametrize("down", [True, False])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_many_buckets_equal_plain_sums(spark, monkeypatch, down, keys):
    monkeypatch.setattr(rk, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(2)
    s = [*map(float, np.unique(np.round(rng.lognormal(0, 3, 900), 3))), float("inf"), float("-inf"), 0.0, -5.5]
    rows = [(k, v, int(rng.integers(9)), float(rng.integers(5))) for k in (["x", None] if keys else ["x"]) for v in sorted(set(s))]
    df = spark.createDataFrame([*rows, ("x", float("nan"), 3, 1.0), ("x", None, 2, 1.0)], "k string, s double, c int, d double").repartition(5)
    got = {(r.k, str(r.s)): (r.cum_c, r.cum_d) for r in rk.running_totals(df, keys, "s", ["c", "d"], descending=down).collect()}
    order = [*[r for r in [("x", None, 2, 1.0)]], *sorted(rows, key=lambda r: r[1]), ("x", float("nan"), 3, 1.0)]
    sums, want = {}, {}
    for k, v, c, d in (reversed(order) if down else order):
        a, b = sums.get(k, (0, 0.0))
        sums[k] = (a + c, b + d)
        want[k, str(v)] = sums[k]
    assert got == want


def test_rows_are_shuffled_once_and_never_sampled(spark, monkeypatch):
    monkeypatch.setattr(rk, "BUCKET_ROWS", 40)
    df = spark.range(1000).select(F.lit("x").alias("k"), (F.col("id") / 7).alias("s"), F.lit(1).alias("c"))
    plan = rk.running_totals(df, ["k"], "s", ["c"])._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert "rangepartitioning" not in initial
    # the rows by (key, bucket); bucket totals and their offsets are tables of a row a bucket
    assert sum("Exchange hashpartitioning" in line and "_bucket" in line and "REPARTITION" in line for line in initial.splitlines()) == 1


def test_equal_values_make_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(rk, "BUCKET_ROWS", 2)
    df = spark.createDataFrame([(str(i), 0.5, 1) for i in range(20)], "k string, s double, c int")
    assert {r.cum_c for r in rk.running_totals(df, ["k"], "s", ["c"]).collect()} == {1}


@pytest.mark.parametrize("report", [fairness_report, performance_full])
@pytest.mark.parametrize("by", [[], ["m"]])
def test_report_reads_its_rows_once(spark, scored, report, by):
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            passed.add(b.num_rows)
            yield b

    seen = scored.mapInArrow(count, scored.schema)
    out = report(seen, AuditSpec(), by).collect()
    assert len(out) == (2 if by else 1) and passed.value == 3000


def test_weighted_report_equals_repeated_rows(spark, scored):
    weighted = fairness_report(scored, AuditSpec(weight="w")).first().asDict()
    repeated = scored.select("*", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("_k"))
    assert weighted == pytest.approx(fairness_report(repeated, AuditSpec()).first().asDict(), abs=1e-6)
