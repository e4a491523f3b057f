"""Quantiles by selection against numpy, k folds by cuts, the data contract."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equilens.functions import quantiles as qt
from equilens.operators import mitigate as mg
from equilens.operators import profile as pf
from equilens.spec import AuditSpec


def columns():
    rng = np.random.default_rng(3)
    return {"normal": rng.normal(size=997), "ties": rng.integers(0, 4, 500).astype(float), "one": np.full(7, 3.5), "single": np.array([-2.0]),
            "heavy": np.exp(rng.normal(size=800) * 40), "wide": np.concatenate([rng.normal(size=50) * 1e308, [1.7e308, -1.7e308]]),
            "close": 1e15 + rng.integers(0, 9, 300), "infinite": np.concatenate([rng.normal(size=30), [np.inf, -np.inf]]), "zeros": np.array([0.0, -0.0, 1.0, 0.0])}


@pytest.mark.parametrize("buckets", [2, 512])
def test_selection_equals_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(qt, "BUCKETS", buckets)
    data = columns() if buckets > 2 else {k: v for k, v in columns().items() if k in ("normal", "ties", "one", "single", "infinite")}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("ties", None), ("none", None)]
    random.Random(1).shuffle(rows)
    qs = [0.0, 0.25, 0.5, 0.77, 1.0]
    got = {r["column"]: r for r in qt.exact_quantiles(spark.createDataFrame(rows, "column string, v double").repartition(4), qs).collect()}
    assert set(got) == set(data)
    for k, v in data.items():
        for i, q in enumerate(qs):
            h = (len(v) - 1) * q
            low, high = np.sort(v)[math.floor(h)], np.sort(v)[math.ceil(h)]
            want = low if low == high else low + (h - math.floor(h)) * (high - low)
            assert got[k][f"q_{i}"] == pytest.approx(want, nan_ok=True), (k, q)


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), ("b", float("nan"))], "column string, v double")
    got = {r["column"]: (r.q_0, r.q_1) for r in qt.exact_quantiles(df, [0.5, 1.0]).collect()}
    assert got["a"][0] == 2.0 and math.isnan(got["a"][1]) and all(map(math.isnan, got["b"]))


@pytest.mark.parametrize("k", [2, 3, 7])
def test_folds_by_cuts(spark, k):
    spec = AuditSpec(score=None, pred=None)
    df = spark.createDataFrame([(i, None if i % 11 == 0 else int(i % 4 == 0)) for i in range(400)] + [(1000, 9), (1001, 9)], "id long, y int")
    got = mg.kfold(df, spec, k).withColumn("h", F.md5(F.concat(F.col("id").cast("string"), F.lit("-fold-42")))).collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: r.h):
        by.setdefault(r.y, []).append(r.fold)
    assert sum(map(len, by.values())) == 402
    for folds in by.values():
        assert folds == [sum(n >= len(folds) * f // k for f in range(1, k)) for n in range(len(folds))]


def test_contract_names_what_is_wrong(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, None)], "id long, y int, x double")
    good = pf.contract_checks(df, "y", {"id": "bigint", "y": "int", "x": "double"}, df).first()
    assert (good.rows_ok, good.columns_ok, good.wrong_columns, good.null_cells, good.default_rate_ok) == (True, True, "", 1, True)
    bad = pf.contract_checks(df.union(df), "y", {"id": "int", "y": "int", "z": "double"}, 2).first()
    assert (bad.rows_ok, bad.columns_ok, bad.wrong_columns) == (False, False, "id,x,z")
    assert pf.contract_checks(df, "y", dict(df.dtypes)).first().rows_ok
