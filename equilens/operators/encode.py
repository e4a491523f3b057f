"""Recoding, group derivation, binning, category codes and column roles
(E1-E9, E13, E14). Dictionaries are small DataFrames joined to the fact
table, so the mapping is data, not code, and the join is planned by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import recode
from ..session import write_once
from ..spec import AuditSpec


def recode_target(df: DataFrame, col: str, mapping: dict, out: str = "y") -> DataFrame:
    """Map outcome codes (e.g. {1: 0, 2: 1}); unmapped values become NULL."""
    return df.withColumn(out, recode(col, mapping).cast("int"))


def dictionary_frame(spark: SparkSession, pairs: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(list(pairs), list(names))


def derive_group(df: DataFrame, col: str, dictionary: DataFrame, privileged_label: str,
                 label_out: str = "group_label", binary_out: str = "g") -> DataFrame:
    """E2 + E6: group label from a code -> label dictionary (left join, so an
    unmapped code gives NULL) and its binary form (privileged = 1)."""
    d = dictionary.select(F.col(dictionary.columns[0]).alias("_code"), F.col(dictionary.columns[1]).alias(label_out))
    # Spark knows the size of a code list (or of the table it is read from) and picks the join by it
    out = df.join(d, F.col(col) == F.col("_code"), "left").drop("_code")
    return out.withColumn(binary_out, F.when(F.col(label_out).isNotNull(),
                                             (F.col(label_out) == F.lit(privileged_label)).cast("int")))


def code_dictionary(df: DataFrame, col: str, dictionary: DataFrame) -> DataFrame:
    """Every dictionary code with its meaning and the number of rows using
    it (0 for unseen codes). Counts are aggregated first, then the dictionary
    is left-joined to the (small) count table."""
    counts = df.groupBy(F.col(col).alias("_code")).agg(F.count(F.lit(1)).alias("n"))
    d = dictionary.select(F.col(dictionary.columns[0]).alias("code"), F.col(dictionary.columns[1]).alias("meaning"))
    return d.join(counts, d.code == counts._code, "left").select(
        "code", "meaning", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def code_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E5 fit: (_c, _v, _code) of every distinct value of the columns, codes in lexicographic order
    (A40, A41, A410, A42, ...). Distinct values of all columns come from one unpivoted pass, ranked
    per column by a distributed running count; the table is written once."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v"))
                                           for c in cols])).alias("_u")).select("_u._c", "_u._v") \
               .where(F.col("_v").isNotNull()).distinct()
    # rank = running count of distinct values in value order, from the two-level
    # prefix sum, so even a high-cardinality column is never sorted in one task
    from ..functions.ranking import running_totals
    ranked = running_totals(values.withColumn("_one", F.lit(1)), ["_c"], "_v", ["_one"], descending=False)
    return write_once(ranked.select("_c", "_v", (F.col("cum__one") - 1).cast("int").alias("_code")), "codes")


def category_codes(df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """E5: integer codes in lexicographic order of the distinct values, NULL -> -1. The code table
    is joined back by value; the join is planned from its true size."""
    codes = code_table(df, cols)
    out = df
    for c in cols:
        cc = codes.where(F.col("_c") == c).select(F.col("_v").alias(f"_v_{c}"), F.col("_code").alias(f"{c}{suffix}"))
        out = out.join(cc, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}") \
                 .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(-1)))
    return out


#: Codes of a null and of a value that the fitted table doesn't hold.
NULL_CODE, UNSEEN_CODE = -1, -2


class CategoryEncoder:
    """E5 fitted once and kept (Q6): the codes of the rows it was fitted on serve later tables too.
    ``transform`` puts the codes in the columns' place: nulls get -1, values that the fit did not see
    -2, so that neither takes another value's code. Columns keep their order."""

    def __init__(self, cols: Sequence[str], codes: DataFrame | None = None):
        self.cols, self.codes = list(cols), codes

    def fit(self, df: DataFrame) -> "CategoryEncoder":
        self.codes = code_table(df, self.cols).select(F.col("_c").alias("column"), F.col("_v").alias("value"), F.col("_code").alias("code"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.codes is None:
            raise ValueError("CategoryEncoder not fitted: call fit() first")
        out = df
        for c in self.cols:
            own = self.codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            out = out.join(own, F.col(c).cast("string") == F.col("_value"), "left").withColumn(
                c, F.when(F.col(c).isNull(), F.lit(NULL_CODE)).otherwise(F.coalesce("_code", F.lit(UNSEEN_CODE)))).drop("_value", "_code")
        return out.select(*df.columns)

    def save(self, path: str) -> None:
        self.codes.write.mode("overwrite").partitionBy("column").parquet(f"{path}/codes")
        self.codes.sparkSession.createDataFrame([(self.cols,)], "columns array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CategoryEncoder":
        cols = list(spark.read.schema("columns array<string>").json(f"{path}/columns").first()["columns"])
        return cls(cols, spark.read.schema("value string, code int, column string").parquet(f"{path}/codes"))


def drop_columns(df: DataFrame, cols: Sequence[str] = (), non_numeric: bool = False) -> DataFrame:
    """Drop named columns (absent names are ignored) or every non-numeric one."""
    from .profile import numeric_columns
    if non_numeric:
        keep = set(numeric_columns(df))
        return df.select(*[c for c in df.columns if c in keep])
    return df.drop(*cols)


def feature_columns(df: DataFrame, spec: AuditSpec, protected: Sequence[str]) -> list[str]:
    """features = all columns - protected attributes - target - id."""
    excluded = set(protected) | {spec.label, spec.id}
    return [c for c in df.columns if c not in excluded]


def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Reorder to the training feature order; the error lists what is missing."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*features)


def stratum_key(df: DataFrame, spec: AuditSpec, out: str = "stratum") -> DataFrame:
    """Label and group as one string key, e.g. '0_1'."""
    return df.withColumn(out, F.concat_ws("_", F.col(spec.label).cast("string"), F.col(spec.group).cast("string")))
