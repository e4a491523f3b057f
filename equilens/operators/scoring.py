"""Scoring decisions for whole tables (O1-O6): the per-request path of an
online service re-aimed at batches and micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, r6, safe_div
from ..spec import RISK_TIER_CUTS, AuditSpec
from .thresholds import apply_thresholds

# --- fixed values: response texts ------------------------------------------
LABEL_GOOD = "Good Credit"
LABEL_DEFAULT = "Default Risk"
TIER_LOW, TIER_MEDIUM, TIER_HIGH = "Low", "Medium", "High"
MODEL_VERSION = "1.0.0"
# ---------------------------------------------------------------------------


# --- fixed values: typed application record and its ranges ---------------
REQUEST_FIELDS = ("status", "duration", "credit_history", "purpose", "amount", "savings", "employment_duration",
                  "installment_rate", "personal_status_sex", "other_debtors", "present_residence", "property", "age",
                  "other_installment_plans", "housing", "number_credits", "job", "people_liable", "telephone",
                  "foreign_worker")
REQUEST_RANGES = {"status": (0, None), "duration": (1, 72), "credit_history": (0, None), "purpose": (0, None),
                  "amount": (250, 20000), "savings": (0, None), "employment_duration": (0, None),
                  "installment_rate": (1, 4), "personal_status_sex": (0, None), "other_debtors": (0, None),
                  "present_residence": (1, 4), "property": (0, None), "age": (18, 100),
                  "other_installment_plans": (0, None), "housing": (0, None), "number_credits": (1, 4),
                  "job": (0, None), "people_liable": (1, 2), "telephone": (0, None), "foreign_worker": (0, None)}
# ---------------------------------------------------------------------------


def request_schema():
    """Typed application record: 20 required INT fields and an optional
    INT ``gender`` (group)."""
    from pyspark.sql.types import IntegerType, StructField, StructType
    return StructType([StructField(f, IntegerType(), True) for f in REQUEST_FIELDS] +
                      [StructField("gender", IntegerType(), True)])


def request_rules():
    """E15 rules of the application record (every field required, gender optional)."""
    from .validate import Rule
    return tuple(Rule(f, lo, hi, True) for f, (lo, hi) in REQUEST_RANGES.items())


def parse_applications(df: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON application records (a table column or a Kafka / file stream
    value) parsed with the fixed schema by ``from_json`` (JVM-side)."""
    return df.select(F.from_json(F.col(json_col).cast("string"), request_schema()).alias("r")).select("r.*")


def request_decisions(lines: DataFrame, schema, rules, model, id_col: str, out: str = "prediction", score: str = "p_model",
                      text: str = "value") -> DataFrame:
    """S11 + E15 + O1 + H6 on a table or a stream of JSON lines: parsed, checked and scored by a fitted
    ``PipelineModel`` in one pass. Every line gives one row: ``id_col``, ``status`` (``malformed``: no JSON
    object of the schema's types; ``rejected``: rules broken; else ``scored``), ``violations`` (comma-joined),
    ``line`` (the text where it is malformed), ``score``, decision ``out`` and ``fairness_adjusted`` (null unless
    scored). A null or empty line is malformed. Fields that the schema doesn't name are ignored."""
    from pyspark.sql.types import StringType, StructField, StructType

    from .validate import violation_array
    whole = StructType([*schema.fields, StructField("_broken", StringType(), True)])
    parsed = lines.select(F.col(text).alias("_line"), F.from_json(F.col(text).cast("string"), whole, {"columnNameOfCorruptRecord": "_broken"}).alias("_r"))
    # a broken record may be filled in part: none of it counts
    bad = F.col("_r").isNull() | F.col("_r._broken").isNotNull()
    rows = parsed.select("_line", bad.alias("_bad"), *[F.when(~bad, F.col(f"_r.`{f.name}`")).alias(f.name) for f in schema.fields])
    rows = rows.withColumn("violations", F.when(F.col("_bad"), F.lit("")).otherwise(F.array_join(violation_array(rules), ",")))
    rows = rows.withColumn("status", F.when(F.col("_bad"), "malformed").when(F.col("violations") != "", "rejected").otherwise("scored"))
    done = model.transform(rows)
    ok = F.col("status") == "scored"
    return done.select(id_col, "status", "violations", F.when(F.col("_bad"), F.col("_line")).alias("line"),
                       *[F.when(ok, F.col(c)).alias(c) for c in (score, out, "fairness_adjusted")])


def risk_tier(p: str) -> F.Column:
    """O3: Low below 0.3, Medium below 0.6, else High (on the probability,
    not on the adjusted decision)."""
    lo, hi = RISK_TIER_CUTS
    return F.when(F.col(p) < lo, F.lit(TIER_LOW)).when(F.col(p) < hi, F.lit(TIER_MEDIUM)).otherwise(F.lit(TIER_HIGH))


def score_with_bundle(df: DataFrame, bundle: dict, spec: AuditSpec, out: str = "prediction") -> DataFrame:
    """S10 + O1 + H6: rows scored by a loaded bundle: its preprocessor, its model, its group thresholds
    (the default cut where it has none)."""
    from .prep import Preprocessor
    from .search import predict_scores
    from .thresholds import apply_thresholds
    prep = Preprocessor.from_statistics(bundle["preprocessor"])
    scored = predict_scores(bundle["model"], prep.transform(df), prep.cols, "p_model")
    return apply_thresholds(scored, spec.with_(score="p_model"), bundle["thresholds"], out=out)


def score_batch(df: DataFrame, model, features: Sequence[str], preprocessor=None,
                spec: AuditSpec | None = None, out: str = "p") -> DataFrame:
    """O1: drop nothing but select the training feature order, preprocess with
    the fitted statistics, assemble, and take P(class 1) from the model's
    probability vector (``vector_to_array``, JVM-side)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    x = preprocessor.transform(df) if preprocessor is not None else df
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    scored = model.transform(va.transform(x).withColumnRenamed("_features", model.getFeaturesCol()))
    return scored.withColumn(out, vector_to_array(F.col(model.getProbabilityCol()))[1]) \
                 .drop(model.getFeaturesCol(), model.getProbabilityCol(), model.getRawPredictionCol(),
                       model.getPredictionCol())


def score_decisions(df: DataFrame, spec: AuditSpec, thresholds: DataFrame | None,
                    version: str = MODEL_VERSION) -> DataFrame:
    """O2 + O4 + O5: decision with the group threshold when the group is given
    and fitted (else 0.5), label text, probabilities, tier and version."""
    d = apply_thresholds(df, spec, thresholds, out="prediction")
    p = F.col(spec.score)
    return d.select(
        spec.id, F.col("prediction").cast("int").alias("prediction"),
        F.when(F.col("prediction") == 0, F.lit(LABEL_GOOD)).otherwise(F.lit(LABEL_DEFAULT)).alias("prediction_label"),
        r6(p).alias("probability_default"), r6(1 - p).alias("probability_good"),
        risk_tier(spec.score).alias("risk_level"), "fairness_adjusted", F.lit(version).alias("model_version"))


def risk_tiers(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """O3 as a table: rows, defaults and mean score per tier."""
    return df.withColumn("risk_level", risk_tier(spec.score)).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col(spec.label) == 1).alias("n_default"),
        r6(F.avg(spec.score)).alias("mean_score"))


def tier_mix(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """Tier shares within each group (monitoring view of O3); group
    totals come from conditional sums over the (group, tier) table."""
    from pyspark.sql import Window
    cnt = df.where(F.col(spec.group).isNotNull()).withColumn("risk_level", risk_tier(spec.score)) \
            .groupBy(spec.group, "risk_level").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(spec.group))
    return cnt.select(spec.group, "risk_level", "n", r6(safe_div(F.col("n"), tot)).alias("share"))
