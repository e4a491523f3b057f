"""Input range validation (E15, E16, O9 batch side).

A constraint is (column, lower, upper, required). Each row gets the list of
rules it breaks as an array built from CASE expressions (no UDF), so valid and
rejected rows can be split without raising, and violations can be counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    column: str
    lower: float | None = None
    upper: float | None = None
    required: bool = True


def violation_array(rules: Sequence[Rule]):
    checks = []
    for r in rules:
        c = F.col(r.column)
        if r.required:
            checks.append(F.when(c.isNull(), F.lit(f"{r.column}:required")))
        if r.lower is not None:
            checks.append(F.when(c < F.lit(r.lower), F.lit(f"{r.column}:ge")))
        if r.upper is not None:
            checks.append(F.when(c > F.lit(r.upper), F.lit(f"{r.column}:le")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate_ranges(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns plus ``n_violations``, ``violations`` (comma-joined
    rule names, '' when valid) and ``valid``."""
    v = violation_array(rules)
    return df.select(*keep, v.alias("_v")).select(
        *keep, F.size("_v").cast("int").alias("n_violations"),
        F.array_join("_v", ",").alias("violations"), (F.size("_v") == 0).alias("valid"))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows (with a ``violations`` array)."""
    v = violation_array(rules)
    marked = df.withColumn("violations", v)
    return (marked.where(F.size("violations") == 0).drop("violations"),
            marked.where(F.size("violations") > 0))


def validation_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Number of rows breaking each rule (explode, then a grouped count)."""
    v = violation_array(rules)
    return df.select(F.explode(v).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
