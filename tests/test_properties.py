"""Property tests: results do not depend on row order or partitioning, and
weighted metrics with unit weights equal the unweighted ones."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equilens.operators import fairness as fm
from equilens.operators import thresholds as th
from equilens.spec import AuditSpec

SPEC = AuditSpec()

rows_st = st.lists(
    st.tuples(st.integers(0, 1), st.integers(0, 1), st.sampled_from([0.05, 0.2, 0.35, 0.5, 0.5, 0.65, 0.8, 0.95])),
    min_size=8, max_size=60)


def frame(spark, rows):
    data = [(i, y, g, p, int(p >= 0.5)) for i, (y, g, p) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, y int, g int, p double, pred int")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st)
def test_report_invariant_to_partitioning(spark, rows):
    df = frame(spark, rows)
    a = fm.fairness_report(df, SPEC).first().asDict()
    b = fm.fairness_report(df.repartition(5, "id").orderBy(F.rand(3)), SPEC).first().asDict()
    assert a == b


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st)
def test_unit_weights_equal_unweighted(spark, rows):
    df = frame(spark, rows).withColumn("w", F.lit(1.0))
    a = fm.fairness_metrics(df, SPEC).first().asDict()
    b = fm.fairness_metrics(df, SPEC.with_(weight="w")).first().asDict()
    assert a == b


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st)
def test_threshold_fit_deterministic(spark, rows):
    df = frame(spark, rows)
    a = sorted(map(tuple, th.fit_thresholds(df, SPEC).collect()))
    b = sorted(map(tuple, th.fit_thresholds(df.repartition(3), SPEC).collect()))
    assert a == b


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=120,
                     unique_by=lambda t: (t[0], t[1])))
def test_running_totals_any_keys(spark, vals):
    from equilens.functions.ranking import running_totals
    df = spark.createDataFrame([(k, float(s), c) for k, s, c in vals], "k int, s double, c long")
    got = {(r.k, r.s): r.cum_c for r in running_totals(df, ["k"], "s", ["c"], descending=False).collect()}
    for k, s, _ in vals:
        assert got[(k, float(s))] == sum(c for kk, ss, c in vals if kk == k and ss <= s)
