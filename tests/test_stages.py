"""Pipeline stages, request stream, late rows."""

import datetime as dt
import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from equilens.operators import prep as pp
from equilens.operators import scoring as sc
from equilens.operators import search as se
from equilens.operators import stages as sg
from equilens.operators import thresholds as th
from equilens.operators.validate import Rule
from equilens.spec import AuditSpec
from equilens.streaming import monitor as mo

SPEC = AuditSpec()
LR = {"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": 1.0}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("g"), ((F.col("id") * 37) % 100 >= 55).cast("int").alias("y"),
                                   F.when(F.col("id") % 9 != 0, (F.col("id") * 37) % 100 / 10.0 + F.col("id") % 2).alias("a"),
                                   ((F.col("id") * 11) % 13).cast("double").alias("b"), F.lit(4).alias("k"), F.lit(None).cast("double").alias("none"))


@pytest.fixture(scope="module")
def fitted(spark, frame, tmp_path_factory):
    model = sg.audit_pipeline(["a", "b", "k"], se.family_estimator(LR, n_rows=600), SPEC).fit(frame)
    path = str(tmp_path_factory.mktemp("m") / "pipeline")
    model.write().save(path)
    return model, PipelineModel.load(path)


def test_loaded_pipeline_equals_plain_functions(frame, fitted):
    cols = ["a", "b", "k"]
    x = pp.Preprocessor(cols).fit(frame).transform(frame)
    plain = se.predict_scores(se.fit_family(x, LR, cols, "y", n_rows=600), x, cols)
    spec = SPEC.with_(score="p_model")
    want = {r.id: r for r in th.apply_thresholds(plain, spec, th.fit_thresholds(plain, spec), out="prediction").collect()}
    for model in fitted:
        got = model.transform(frame).collect()
        assert len(got) == 600
        for r in got:
            assert abs(r.p_model - want[r.id].p_model) < 1e-12
            assert (r.prediction, r.fairness_adjusted) == (want[r.id].prediction, want[r.id].fairness_adjusted)


def test_transform_has_no_join_and_no_python(fitted, frame):
    plan = fitted[1].transform(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan


def test_prep_of_a_feature_without_values_and_unknown_groups(frame, fitted):
    m = sg.FeaturePrep(inputCols=["k", "none"]).fit(frame)
    assert {(r.k, r.none) for r in m.transform(frame).select("k", "none").distinct().collect()} == {(0.0, None)}
    odd = frame.limit(2).withColumn("g", F.when(F.col("id") == frame.first().id, F.lit(7)))
    assert [r.fairness_adjusted for r in fitted[1].transform(odd).collect()] == [False, False]


def test_request_lines_of_every_kind(spark, frame, fitted, tmp_path):
    good = {"id": 1, "g": 1, "a": 3.0, "b": 2.0, "k": 4}
    lines = [json.dumps(good), json.dumps(good | {"id": 2, "a": None, "unknown": 1}), json.dumps(good | {"id": 3, "b": -1.0}),
             json.dumps(good)[:-5], json.dumps(good | {"b": "two"}), "", "null", "[]x", json.dumps(good | {"id": 4, "g": None})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part.txt").write_text("\n".join(lines) + "\n")
    schema = StructType.fromDDL("id bigint, g int, a double, b double, k int")
    rules = (Rule("b", 0, None, True), Rule("a", None, 100, False))

    def decided(df):
        return sc.request_decisions(df, schema, rules, fitted[1], "id")
    got = mo.run_available(spark, decided(spark.readStream.text(str(tmp_path / "in"))), "requests")
    rows = got.collect()
    assert sorted(r.line for r in rows if r.status == "malformed") == sorted([lines[3], lines[4], "", "null", "[]x"])
    assert {r.id: (r.status, r.violations) for r in rows if r.id is not None} == {
        1: ("scored", ""), 2: ("scored", ""), 3: ("rejected", "b:ge"), 4: ("scored", "")}
    assert all((r.prediction is None) == (r.status != "scored") and (r.p_model is None) == (r.status != "scored") for r in rows)
    assert {r.id: r.fairness_adjusted for r in rows if r.status == "scored"} == {1: True, 2: True, 4: False}
    key = F.xxhash64("id", "status", "line", "p_model", "prediction")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(
        r[0] for r in decided(spark.createDataFrame([(x,) for x in lines], "value string")).select(key).collect())


def test_late_rows_are_counted_over_replays(spark, tmp_path):
    day = dt.datetime(2024, 5, 1)
    files = [[day + dt.timedelta(days=5, hours=h) for h in (1, 2, 10)], [day + dt.timedelta(days=5, hours=3), None],
             [day, day + dt.timedelta(days=2), day + dt.timedelta(days=5, hours=4), day + dt.timedelta(days=4, hours=23)]]
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    late = []
    for k, times in enumerate(files):
        rows = [(k * 10 + i, t, i, "error" if i % 2 else "view", 1.0, "") for i, t in enumerate(times)]
        spark.createDataFrame(rows, mo.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        events = mo.as_events(spark.readStream.schema(mo.EVENT_SCHEMA).parquet(src))
        windows, acc = mo.window_parity_accounts(spark, events, "1 day", "late", out=out, ckpt=ckpt)
        late.append(tuple(acc.first()))
    # read, without time, counted, late
    assert late == [(3, 0, 3, 0), (5, 1, 4, 0), (9, 1, 5, 3)]
    assert [(r.window_start, r.n) for r in windows.collect()] == [("2024-05-06 00:00:00", 5)]
    again = mo.window_parity_accounts(spark, events, "1 day", "late", out=out, ckpt=ckpt)[1]   # nothing new
    assert tuple(again.first()) == (9, 1, 5, 3)


def test_streams_without_any_input(spark, tmp_path):
    (tmp_path / "none").mkdir()
    events = mo.as_events(spark.readStream.schema(mo.EVENT_SCHEMA).parquet(str(tmp_path / "none")))
    for mode, stream in (("append", events), ("update", mo.window_parity(events, "1 day"))):
        out = mo.run_available(spark, stream, "empty", mode, keys=["window_start"])
        assert out.columns == stream.columns and out.count() == 0
    valid, rejected = mo.validate_stream(spark, events, (Rule("value", 0, 1, True),), "empty")
    assert valid.count() == rejected.count() == 0 and "violations" in rejected.columns
    assert tuple(mo.window_parity_accounts(spark, events, "1 day", "empty")[1].first()) == (0, 0, 0, 0)
