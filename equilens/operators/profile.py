"""Profiling (P1-P7): shape, nulls, value counts, numeric summary, contract
checks and feature-label correlation. Each is one aggregate over the frame
(several columns at once through an unpivot), never one job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.exprs import count_if, r6, safe_div
from ..functions.quantiles import exact_quantiles, unpivot_numeric


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a numeric type (schema metadata, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def dtype_counts(df: DataFrame) -> dict[str, int]:
    """P5: number of columns per type (driver metadata only)."""
    out: dict[str, int] = {}
    for f in df.schema.fields:
        out[f.dataType.simpleString()] = out.get(f.dataType.simpleString(), 0) + 1
    return out


def profile_shape(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and string column counts in one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(string_columns(df))).alias("n_string"))


def profile_nulls(df: DataFrame, only_nonzero: bool = True) -> DataFrame:
    """P2 (+F5): NULL count per column from one aggregate, unpivoted; by
    default only columns with at least one NULL are kept."""
    cols = df.columns
    agg = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols])).alias("u")) \
        .select("u.column", "u.n_null")
    return long.where(F.col("n_null") > 0) if only_nonzero else long


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for many columns in one pass (unpivot, then one
    grouped count with map-side partial counts)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("u")) \
        .select("u.column", "u.value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def describe_numeric(df: DataFrame, cols: Sequence[str], approx_accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per column.

    Quartiles are exact with linear interpolation by default (distributed,
    see ``functions.quantiles``). With ``approx_accuracy`` they come from
    ``percentile_approx`` in the same single aggregate instead: one pass and
    bounded memory, at the cost of rank error 1/accuracy (no interpolation)."""
    long = unpivot_numeric(df, cols)
    extra = []
    if approx_accuracy:
        pa = F.percentile_approx("v", [0.25, 0.5, 0.75], approx_accuracy)
        extra = [pa[0].alias("q_0"), pa[1].alias("q_1"), pa[2].alias("q_2")]
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"), *extra)
    if approx_accuracy:
        return basic.select(
            "column", "count", r6("mean").alias("mean"), r6("std").alias("std"), r6("min").alias("min"),
            r6("q_0").alias("q25"), r6("q_1").alias("q50"), r6("q_2").alias("q75"), r6("max").alias("max"))
    qs = exact_quantiles(long, [0.25, 0.5, 0.75])
    return basic.join(qs, "column", "left").select(
        "column", "count", r6("mean").alias("mean"), r6("std").alias("std"), r6("min").alias("min"),
        r6("q_0").alias("q25"), r6("q_1").alias("q50"), r6("q_2").alias("q75"), r6("max").alias("max"))


def contract_checks(df: DataFrame, label: str, expected_types: dict[str, str], expected_rows: DataFrame | int | None = None,
                    rate_range: tuple[float, float] = (0.2, 0.5)) -> DataFrame:
    """Measured values beside what the contract says, in one row: row count
    (a number, or a frame of which each row must have become one), columns by
    name and type, NULL cells, target domain {0, 1} and default-rate range.
    ``wrong_columns`` names columns that are missing, not expected or of
    another type, sorted and comma-joined."""
    y = F.col(label)
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.coalesce(F.sum(nulls), F.lit(0)).cast("bigint").alias("null_cells"),
                 count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_target"),
                 count_if(y == 1).alias("_d"), count_if(y.isNotNull()).alias("_n"))
    if isinstance(expected_rows, DataFrame):
        agg = agg.crossJoin(expected_rows.agg(F.count(F.lit(1)).alias("expected_rows")))   # one row each
    else:
        agg = agg.withColumn("expected_rows", F.lit(expected_rows).cast("bigint"))
    found = dict(df.dtypes)
    wrong = sorted(c for c in found.keys() | expected_types.keys() if found.get(c) != expected_types.get(c))
    rate = safe_div(F.col("_d"), F.col("_n"))
    return agg.select(
        "n_rows", "expected_rows", F.coalesce(F.col("n_rows") == F.col("expected_rows"), F.col("n_rows") > 0).alias("rows_ok"),
        F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(wrong)).alias("wrong_columns"), F.lit(not wrong).alias("columns_ok"),
        "null_cells", "bad_target", (F.col("bad_target") == 0).alias("target_domain_ok"),
        r6(rate).alias("default_rate"),
        F.coalesce((rate >= rate_range[0]) & (rate <= rate_range[1]), F.lit(False)).alias("default_rate_ok"))


def feature_correlation(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of every numeric feature with the label, one
    grouped aggregate over the unpivoted features."""
    long = df.select(F.col(label).cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("u")) \
        .select("u.column", "u.v", "_y")
    return long.groupBy("column").agg(r6(F.corr("v", "_y")).alias("corr_with_label"),
                                      F.count("v").alias("n"))
