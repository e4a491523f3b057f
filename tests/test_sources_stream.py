"""Readers, writers, streaming (late data, stream = batch) and plan shape."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from equilens.operators.validate import Rule, validate_ranges, validation_summary
from equilens.sources import store
from equilens.streaming import monitor as mo

SF = "/root/testdata/sf0.001"

RAW_SAMPLE = """A13 9 A33 A42 2222 A63 A72 3 A91 A103 1 A122 33 A141 A151 2 A174 2 A192 A202 1
A14 30 A31 A40 7777 A62 A75 1 A94 A102 3 A123 58 A142 A153 1 A171 1 A191 A201 2
A11 15 A30 A49 3333 A64 A71 4 A92 A101 2 A124 41 A143 A152 3 A172 1 A192 A201 1
"""


def test_raw_reader_fixed_schema(spark, tmp_path):
    p = tmp_path / "raw.data"
    p.write_text(RAW_SAMPLE)
    df = store.read_raw_decisions(spark, str(p))
    assert df.count() == 3 and len(df.columns) == 21
    assert dict(df.dtypes)["age"] == "int"
    assert [r.credit_risk for r in df.orderBy("amount").collect()] == [1, 1, 2]
    with pytest.raises(FileNotFoundError):
        store.read_raw_decisions(spark, str(tmp_path / "missing.data"))


def test_numeric_variant_split_on_blanks(spark, tmp_path):
    p = tmp_path / "num.data"
    p.write_text("   1   6   4  12   5\n   2  48   2  60   1  \n")
    df = store.read_numeric_variant(spark, str(p), n_cols=5)
    assert [tuple(r) for r in df.collect()] == [(1, 6, 4, 12, 5), (2, 48, 2, 60, 1)]


def test_split_roundtrip_prunes_partitions(spark, tmp_path):
    from equilens.spec import AuditSpec
    df = spark.range(100).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"),
                                 F.when(F.col("id") < 20, "test").otherwise("train").alias("split"))
    store.save_split(df, str(tmp_path / "s"), AuditSpec(), ["id"])
    test = store.load_split(spark, str(tmp_path / "s"), "test")
    assert test.count() == 20
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan
    assert store.load_roles(spark, str(tmp_path / "s"))["features"] == ["id"]


def test_validate_ranges(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, -1.0, 3.0), (3, 2.0, 2.0)], "id long, a double, b double")
    rules = (Rule("a", 0, 10, True), Rule("b", None, 2.5, True))
    out = {r.id: r.violations for r in validate_ranges(df, rules, ["id"]).collect()}
    assert out == {1: "b:required", 2: "a:ge,b:le", 3: ""}
    assert {r.rule: r.n for r in validation_summary(df, rules).collect()} == {"b:required": 1, "a:ge": 1, "b:le": 1}


def test_stream_windows_equal_batch(spark):
    from equilens.plans.catalog import queries
    q = queries()
    s = q["stream_tumbling"](spark, SF).orderBy("window_start").collect()
    ev = spark.read.parquet(f"{SF}/events.parquet")
    days = ev.select(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss").alias("d")).groupBy("d").count()
    assert {r.window_start: r.n for r in s} == {r.d: r["count"] for r in days.collect()}


def test_update_mode_keeps_rows_of_earlier_batches(spark, tmp_path):
    """Two files in two batches, two day windows: both are in the result, once each, with their newest counts."""
    cols = "event_id long, ts string, user_id long, event_type string, value double, props string"
    days = [("2024-01-02 10:00:00", 1), ("2024-01-02 11:00:00", 2), ("2024-01-03 10:00:00", 3)]
    flat = str(tmp_path / "flat")
    for k, rows in enumerate([days[:1], days[1:]]):
        spark.createDataFrame([(i, t, i, "view", 1.0, "{}") for t, i in rows], cols).withColumn("ts", F.to_timestamp_ntz("ts")) \
             .coalesce(1).write.mode("append").parquet(flat)
    stream = spark.readStream.schema(mo.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(flat).select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.lit(0).alias("y"),
        (F.col("user_id") % 2).cast("int").alias("g"))
    out = mo.run_available(spark, mo.window_parity(stream, "1 day", watermark="3 days"), "upd", "update", keys=["window_start", "window_end"])
    assert {r.window_start: r.n for r in out.collect()} == {"2024-01-02 00:00:00": 2, "2024-01-03 00:00:00": 1}
    with pytest.raises(ValueError):
        mo.run_available(spark, mo.window_parity(stream, "1 day"), "upd2", "update")


def test_appended_files_in_partition_folders_are_seen(spark, tmp_path):
    from equilens.sources.tables import read_table
    path = f"{tmp_path}/t.parquet"
    spark.range(10).withColumn("k", F.lit(1)).write.partitionBy("k").parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 10
    spark.range(5).withColumn("k", F.lit(1)).write.mode("append").partitionBy("k").parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 15


def test_thresholds_keep_the_fitted_objective(spark):
    """Scores k / 1460 don't survive rounding: the applied gap must equal the fitted one."""
    from equilens.operators import thresholds as th
    from equilens.spec import DECISIONS
    rows = [(k, k % 2, int((k * 7919) % 11 < 4), ((k * 7919) % 1000 + 200) / 1460.0) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g int, y int, p double")
    t = th.fit_thresholds(df, DECISIONS)
    fitted = {r.g: r.objective for r in t.collect()}
    gap = {r.g: r.tpr_gap for r in th.threshold_effect(df, DECISIONS, t).collect()}
    assert abs(gap[0] - fitted[0]) < 1e-6


def test_missing_group_gives_an_undefined_verdict(spark):
    from equilens.operators.audit import bias_verdict
    from equilens.spec import DECISIONS
    one = spark.createDataFrame([(1, 1, 0, 0.2), (2, 1, 1, 0.7)], "id long, g int, y int, p double")
    assert {bias_verdict(one, DECISIONS).first()[c] for c in ("verdict", "di_status", "spd_direction")} == {"undefined"}
    even = spark.createDataFrame([(i, i % 2, i // 2 % 2, 0.5) for i in range(8)], "id long, g int, y int, p double")
    assert bias_verdict(even, DECISIONS).first().spd_direction == "no_difference"


def test_late_rows_dropped_in_append_mode(spark, tmp_path):
    """Two runs on one checkpoint: the second file holds an event far behind
    the watermark set by the first run, so append mode drops it."""
    src = tmp_path / "ev"
    src.mkdir()
    sch = mo.EVENT_SCHEMA
    first = spark.createDataFrame([(1, "2024-01-02 10:00:00", 1, "view", 1.0, "{}"),
                                   (2, "2024-01-05 10:00:00", 2, "view", 1.0, "{}")],
                                  "event_id long, ts string, user_id long, event_type string, value double, props string") \
        .withColumn("ts", F.to_timestamp_ntz("ts"))
    late = spark.createDataFrame([(3, "2024-01-01 10:00:00", 1, "error", 1.0, "{}"),
                                  (4, "2024-01-06 10:00:00", 1, "error", 1.0, "{}")],
                                 "event_id long, ts string, user_id long, event_type string, value double, props string") \
        .withColumn("ts", F.to_timestamp_ntz("ts"))
    flat = tmp_path / "flat"
    first.coalesce(1).write.mode("append").parquet(str(flat))

    def stream():
        return spark.readStream.schema(sch).parquet(str(flat)).select(
            F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
            (F.col("event_type") == "error").cast("int").alias("y"), (F.col("user_id") % 2).cast("int").alias("g"))
    out_dir, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    mo.run_available(spark, mo.window_parity(stream(), "1 day", watermark="1 hour"), "late", "append", out_dir, ckpt)
    late.coalesce(1).write.mode("append").parquet(str(flat))      # arrives after the watermark moved on
    out = mo.run_available(spark, mo.window_parity(stream(), "1 day", watermark="1 hour"), "late", "append",
                           out_dir, ckpt)
    starts = {r.window_start for r in out.collect()}
    assert "2024-01-01 00:00:00" not in starts          # late event dropped
    assert "2024-01-02 00:00:00" in starts               # closed by the watermark


def test_plan_pushdown_and_broadcast(spark):
    from equilens.sources.frames import decision_frame
    df = decision_frame(spark, SF).where(F.col("priority") == "1-URGENT").select("id", "y", "g")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderpriority" in plan
    assert "Broadcast" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_orderpriority:string>" in plan


def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].composite_score is not None
    assert set(e.oracle_sql()) <= set(e.queries())


def test_parse_and_validate_applications(spark):
    from equilens.operators.scoring import parse_applications, request_rules
    from equilens.operators.validate import split_valid
    good = ('{"status": 2, "duration": 27, "credit_history": 1, "purpose": 4, "amount": 3210, "savings": 3, '
            '"employment_duration": 1, "installment_rate": 2, "personal_status_sex": 1, "other_debtors": 1, '
            '"present_residence": 2, "property": 2, "age": 52, "other_installment_plans": 1, "housing": 0, '
            '"number_credits": 2, "job": 1, "people_liable": 2, "telephone": 0, "foreign_worker": 1, "gender": 0}')
    bad = good.replace('"age": 52', '"age": 101').replace('"amount": 3210', '"amount": 100')
    df = spark.createDataFrame([(good,), (bad,)], "value string")
    apps = parse_applications(df)
    assert len(apps.columns) == 21
    valid, rejected = split_valid(apps, request_rules())
    assert valid.count() == 1
    assert sorted(rejected.first().violations) == ["age:le", "amount:ge"]


def test_stream_scoring_with_fitted_model_equals_batch(spark, tmp_path):
    """O1 + O7: a Spark ML model fitted in batch scores a stream; the sink
    equals the batch scoring of the same rows."""
    from equilens.operators import search as se
    df = spark.range(300).select(F.col("id"), ((F.col("id") * 37) % 100 / 100.0).alias("x1"),
                                 ((F.col("id") * 11) % 7 / 7.0).alias("x2"),
                                 (((F.col("id") * 37) % 100) >= 60).cast("int").alias("y"))
    model = se.fit_family(df, {"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": 1.0}, ["x1", "x2"])
    src = str(tmp_path / "src")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = mo.run_available(spark, se.predict_scores(model, stream, ["x1", "x2"], "p"), "model-stream", "append")
    batch = se.predict_scores(model, df, ["x1", "x2"], "p")
    assert out.select("id", "p").exceptAll(batch.select("id", "p")).count() == 0
    assert out.count() == 300


def test_bundle_scores_like_the_fitted_parts(spark, tmp_path):
    """Save, load and score: the same scores and decisions as the parts in memory; the model class is found by itself."""
    from equilens.operators import prep as pp
    from equilens.operators import scoring as sc
    from equilens.operators import search as se
    from equilens.operators import thresholds as th
    from equilens.spec import DECISIONS
    df = spark.range(400).select(F.col("id"), (F.col("id") % 2).cast("int").alias("g"), ((F.col("id") * 37) % 100 / 10.0).alias("x1"),
                                 F.when(F.col("id") % 9 != 0, (F.col("id") * 11) % 7).cast("double").alias("x2"),
                                 (((F.col("id") * 37) % 100) >= 60).cast("int").alias("y"))
    prep = pp.Preprocessor(["x1", "x2"]).fit(df)
    train = prep.transform(df)
    spec = DECISIONS.with_(score="p_model")
    for params in ({"model_type": "logistic_regression", "lr_penalty": "l2", "lr_C": 1.0},
                   {"model_type": "random_forest", "rf_n_estimators": 5, "rf_max_depth": 4, "rf_min_samples_split": 2, "rf_min_samples_leaf": 1}):
        path = f"{tmp_path}/{params['model_type']}"
        model = se.fit_family(train, params, ["x1", "x2"])
        scored = se.predict_scores(model, train, ["x1", "x2"], "p_model")
        table = th.fit_thresholds(scored, spec)
        store.save_bundle(path, model=model, thresholds=table, preprocessor_stats=prep.statistics())
        want = th.apply_thresholds(scored, spec, table, out="prediction")
        got = sc.score_with_bundle(df, store.load_bundle(spark, path), spec)
        cols = ["id", "p_model", "prediction", "fairness_adjusted"]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_split_is_loaded_or_created(spark, tmp_path):
    from equilens.spec import DECISIONS
    made = []

    def create():
        made.append(1)
        return spark.createDataFrame([(1, 0, 1, 2.0, "train"), (2, 1, 0, 3.0, "test")], "id long, y int, g int, x double, split string")
    for _ in range(2):
        out = store.split_or_create(spark, f"{tmp_path}/split", DECISIONS, ["x"], create)
        assert sorted((r.id, r.split) for r in out.collect()) == [(1, "train"), (2, "test")]
    assert len(made) == 1
