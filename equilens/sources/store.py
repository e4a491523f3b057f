"""Readers and writers for the audit's inputs and artefacts.

Every artefact is a Spark table or a Spark ML model on shared storage; nothing
is pickled and nothing passes through the driver. Paths are Hadoop paths, so
the same code works on local disk, HDFS or an object store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_once
from ..spec import AuditSpec

# --- fixed values: the raw credit-decision file layout ---------------------
RAW_DDL = ("status STRING, duration INT, credit_history STRING, purpose STRING, amount INT, savings STRING, "
           "employment_duration STRING, installment_rate INT, personal_status_sex STRING, other_debtors STRING, "
           "present_residence INT, property STRING, age INT, other_installment_plans STRING, housing STRING, "
           "number_credits INT, job STRING, people_liable INT, telephone STRING, foreign_worker STRING, "
           "credit_risk INT")
# ---------------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop FileSystem of the path (driver metadata call)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_raw_decisions(spark: SparkSession, path: str, ddl: str = RAW_DDL,
                       on_missing: str = "raise") -> DataFrame | None:
    """Headerless, single-space separated raw table with fixed names and
    types (no inference); a malformed line fails the read (FAILFAST). A
    missing file raises FileNotFoundError with the path, or with
    ``on_missing="report"`` is reported on stderr and gives None."""
    if not path_exists(spark, path):
        if on_missing == "report":
            import sys
            print(f"raw decision file not found: {path}", file=sys.stderr)
            return None
        raise FileNotFoundError(path)
    return spark.read.csv(path, sep=" ", schema=ddl, header=False, mode="FAILFAST")


def read_raw_checked(spark: SparkSession, path: str, ddl: str = RAW_DDL) -> tuple[DataFrame, DataFrame]:
    """S1 with bad lines kept: (good rows, bad lines as ``line``). Bad are lines with too few or too
    many fields or a field that is not of its type; blank lines are neither. The parsed file is written
    once: the reader parses no more columns than a query asks for, so a bad field in an unread column
    would go unseen."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    rows = write_once(spark.read.csv(path, sep=" ", schema=f"{ddl}, _line STRING", header=False, mode="PERMISSIVE",
                                     columnNameOfCorruptRecord="_line"), "raw")
    return rows.where(F.col("_line").isNull()).drop("_line"), rows.where(F.col("_line").isNotNull()).select(F.col("_line").alias("line"))


def read_numeric_variant(spark: SparkSession, path: str, n_cols: int = 25) -> DataFrame:
    """S1 numeric variant: blank-padded integer rows, split on runs of spaces."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(
        *[parts.getItem(i).cast("int").alias(f"c{i + 1}") for i in range(n_cols)])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                header: bool = True) -> None:
    """S3: overwrite a table (parquet, or headered CSV for hand-over)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def read_table_at(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read a processed table; CSV needs an explicit schema (no inference)."""
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV tables are read with an explicit schema")
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.format(fmt).load(path)


def save_split(df: DataFrame, path: str, spec: AuditSpec, features: Sequence[str], split: str = "split") -> None:
    """The split table partitioned by ``split`` (weights, if any, are a
    column and persist with it), plus a one-row roles sidecar."""
    write_table(df, f"{path}/data", partition_by=[split])
    roles = df.sparkSession.createDataFrame(
        [(spec.label, spec.group, list(features), spec.weight or "")],
        "target string, protected string, features array<string>, weight string")
    roles.coalesce(1).write.mode("overwrite").json(f"{path}/roles")


def load_split(spark: SparkSession, path: str, which: str | None = None, split: str = "split") -> DataFrame:
    """Read the split table; a filter on the partition column prunes the
    other split's files at planning time."""
    df = spark.read.parquet(f"{path}/data")
    return df.where(F.col(split) == which) if which else df


def split_or_create(spark: SparkSession, path: str, spec: AuditSpec, features: Sequence[str], create) -> DataFrame:
    """The split table at ``path``; where there is none, ``create()`` makes it and it is saved first."""
    if not path_exists(spark, f"{path}/roles"):   # written last
        save_split(create(), path, spec, features)
    return load_split(spark, path)


def load_roles(spark: SparkSession, path: str) -> dict:
    """S5 roles: the one-row sidecar (a few column names) read on the driver."""
    r = spark.read.json(f"{path}/roles").first()
    return {"target": r["target"], "protected": r["protected"], "features": list(r["features"]),
            "weight": r["weight"] or None}


def save_bundle(path: str, model=None, thresholds: DataFrame | None = None, report: DataFrame | None = None,
                preprocessor_stats: DataFrame | None = None, wrapped: bool = False) -> None:
    """Model (Spark ML writer), thresholds, report and preprocessor
    statistics under one folder."""
    if model is not None:
        model.write().overwrite().save(f"{path}/{'wrapped_model' if wrapped else 'model'}")
    if thresholds is not None:
        write_table(thresholds, f"{path}/thresholds")
    if report is not None:
        write_table(report, f"{path}/report")
    if preprocessor_stats is not None:
        write_table(preprocessor_stats, f"{path}/preprocessor")


def load_bundle(spark: SparkSession, path: str) -> dict:
    """Prefer the wrapped model, else the base model, of whatever class
    was saved (Spark ML keeps it in the model's metadata); model, thresholds,
    report and preprocessor statistics are each None when absent."""
    from pyspark.ml.util import DefaultParamsReader
    out = {"model": None, "thresholds": None, "report": None, "preprocessor": None}
    for name in ("wrapped_model", "model"):
        if path_exists(spark, f"{path}/{name}"):
            out["model"] = DefaultParamsReader.loadParamsInstance(f"{path}/{name}", spark.sparkContext)
            break
    for name in ("thresholds", "report", "preprocessor"):
        if path_exists(spark, f"{path}/{name}"):
            out[name] = spark.read.parquet(f"{path}/{name}")
    return out


REPORT_FIELDS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "roc_auc",
                 "disparate_impact", "statistical_parity_difference")


def model_report(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored metrics (8 values and the compliance flag), or None when
    the bundle has no report."""
    rep = load_bundle(spark, path)["report"]
    if rep is None:
        return None
    return rep.select(*REPORT_FIELDS, F.col("parity_compliant").alias("fairness_compliant"))


def write_history(hist: DataFrame, path: str) -> None:
    """Trial history (params as a JSON string column) as CSV and parquet."""
    write_table(hist, f"{path}/parquet")
    write_table(hist, f"{path}/csv", fmt="csv")


def write_summary(report: DataFrame, best: DataFrame, shapes: dict, path: str, total_trials: int = 0) -> None:
    """Summary document: best model type and parameters, performance and
    fairness structs, trial count and data shapes, as one JSON record."""
    perf = F.struct(*[F.col(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score",
                                         "roc_auc", "average_precision")])
    fair = F.struct(*[F.col(c) for c in ("disparate_impact", "statistical_parity_difference",
                                         "equal_opportunity_difference")])
    rep = report.select(F.col("composite_score"), perf.alias("performance_metrics"), fair.alias("fairness_metrics"))
    b = best.select(F.col("model_type").alias("best_model_type"), F.col("params").alias("best_parameters"))
    shape = F.struct(*[F.array(*[F.lit(int(v)) for v in shapes[k]]).alias(k) for k in shapes])
    doc = b.withColumn("_one", F.lit(1)).join(rep.withColumn("_one", F.lit(1)), "_one").drop("_one") \
           .withColumn("total_trials", F.lit(int(total_trials))).withColumn("data_shape", shape)
    doc.coalesce(1).write.mode("overwrite").json(path)
