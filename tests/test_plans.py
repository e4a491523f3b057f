"""Plan guardrails over every registered query: no Python evaluation nodes,
no cartesian products, and single scans where the report is one aggregate."""

import re

import pytest

import __spark_entry__ as entry
from equilens.plans import catalog

SF = "/root/testdata/sf0.001"
KEYS = sorted(k for k in catalog.queries() if not k.startswith(("train_", "baseline_", "score_batch", "feature_imp", "search_fits")))


@pytest.mark.parametrize("key", KEYS)
def test_no_python_or_cartesian(spark, key):
    df = entry.queries()[key](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|PythonUDF|FlatMapGroupsInPandas|MapInPandas", plan)
    assert "CartesianProduct" not in plan
    if key == "undersample":
        assert "BroadcastNestedLoopJoin" not in plan
    if key == "reweighing":   # a few (group, label) keys must not gather the rows
        assert not re.search(r"SortMergeJoin \[g#\d+, y#\d+\]", plan)


@pytest.mark.parametrize("key", ["group_rates", "subgroup_cube", "group_confusion", "value_counts", "overall_rate"])
def test_single_scan_of_fact_table(spark, key):
    df = entry.queries()[key](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[[^\]]*o_orderkey|FileScan parquet \[[^\]]*o_custkey", plan)) == 1
