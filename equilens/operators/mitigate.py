"""Bias mitigation by weights and reproducible splits.

Splits are defined by a seeded md5 of the row id, so the same rows are chosen
by Spark and by any SQL engine, on any cluster layout, after any retry.
Exact per-stratum counts use the hash up to which a stratum's rows are taken
(``hash_cuts``), never a window over a whole stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_key
from ..functions.ranking import below_cut, hash_cuts
from ..session import write_once
from ..spec import CV_FOLDS, POSITIVE_CLASS_MULTIPLIER, RANDOM_SEED, AuditSpec

SPLIT_SALT = f"-{RANDOM_SEED}"
FOLD_SALT = f"-fold-{RANDOM_SEED}"
SAMPLE_SALT = f"-sample-{RANDOM_SEED}"
# 0x33333333 / 0xffffffff = 0.2: a row is in the test split when the first 8
# hex digits of its hash sort below this value.
TEST_HASH_CUT = "33333333"


def reweighing_table(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """R1 fit: w(g, y) = n_g * n_y / (n * n_gy) (Kamiran & Calders). The
    table has one row per (group, label); margins come from windows over that
    tiny table, not over the data."""
    g, y = spec.group, spec.label
    cnt = df.where(F.col(g).isNotNull() & F.col(y).isNotNull()).groupBy(g, y).agg(F.count(F.lit(1)).alias("n_gy"))
    w_all = Window.partitionBy(F.lit(0))
    return cnt.select(
        g, y, "n_gy",
        F.sum("n_gy").over(Window.partitionBy(g)).alias("n_g"),
        F.sum("n_gy").over(Window.partitionBy(y)).alias("n_y"),
        F.sum("n_gy").over(w_all).alias("n")) \
        .withColumn("weight", (F.col("n_g") * F.col("n_y")).cast("double") /
                    (F.col("n") * F.col("n_gy")).cast("double"))


def apply_weights(df: DataFrame, table: DataFrame, spec: AuditSpec, out: str = "weight") -> DataFrame:
    """R1 apply: join the (group, label) weight table. It is written first, so
    the join is planned from its true size: a small table is broadcast and the
    rows are never shuffled onto a few (group, label) keys. Rows outside the
    table keep weight 1."""
    t = write_once(table.select(spec.group, spec.label, F.col("weight").alias("_w")), "weights")
    return df.join(t, [spec.group, spec.label], "left") \
             .withColumn(out, F.coalesce(F.col("_w"), F.lit(1.0))).drop("_w")


def reweighing(df: DataFrame, spec: AuditSpec, out: str = "weight") -> DataFrame:
    return apply_weights(df, reweighing_table(df, spec), spec, out)


def class_weights(df: DataFrame, spec: AuditSpec, base_weight: str | None = None,
                  out: str = "weight") -> DataFrame:
    """Balanced class weight n / (2 * n_y), multiplied by an existing
    sample weight (e.g. the reweighing weight)."""
    y = spec.label
    cnt = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("_ny"))
    cnt = cnt.select(y, (F.sum("_ny").over(Window.partitionBy(F.lit(0))).cast("double") /
                         (F.lit(2.0) * F.col("_ny"))).alias("class_weight"))
    out_df = df.join(write_once(cnt, "class-weights"), y, "left")   # planned from the table's true size
    base = F.col(base_weight) if base_weight else F.lit(1.0)
    return out_df.withColumn(out, F.col("class_weight") * base)


def positive_class_weight(df: DataFrame, spec: AuditSpec, base_weight: str | None = None,
                          multiplier: float = POSITIVE_CLASS_MULTIPLIER, out: str = "weight") -> DataFrame:
    """Constant multiplier on the positive (default) class."""
    base = F.col(base_weight) if base_weight else F.lit(1.0)
    return df.withColumn(out, F.when(F.col(spec.label) == 1, F.lit(multiplier)).otherwise(F.lit(1.0)) * base)


def holdout_split(df: DataFrame, spec: AuditSpec, out: str = "split") -> DataFrame:
    """T1 (cheap): test when the seeded hash of the id falls in the first 20%
    of the hash space. No shuffle; stratified only in expectation."""
    h = F.substring(md5_key(spec.id, SPLIT_SALT), 1, 8)
    return df.withColumn(out, F.when(h < F.lit(TEST_HASH_CUT), F.lit("test")).otherwise(F.lit("train")))


def holdout_exact(df: DataFrame, spec: AuditSpec, test_fraction_fifths: int = 1, out: str = "split",
                  strata: Sequence[str] | None = None) -> DataFrame:
    """T1 (exact): in every (label, group) stratum exactly round(0.2 * n_s)
    rows go to test: those with the smallest seeded hash. Only the hashes of the
    bucket that a stratum's cut falls into are ranked; all rows are then decided
    by comparison with their stratum's cut. Rows that repeat an id fall on one
    side together; rows of a null stratum are a stratum of their own."""
    strata = list(strata or [spec.label, spec.group])
    hashed = df.withColumn("_h", md5_key(spec.id, SPLIT_SALT))
    # round(n_s / 5) with integer arithmetic (fractions .2/.4 round down, .6/.8 up)
    k = ((F.col("_n") * test_fraction_fifths + 2) / 5).cast("bigint")
    marked = below_cut(hashed, hash_cuts(hashed, strata, "_h", k), strata, "_h", "_test")
    return marked.withColumn(out, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))).drop("_h", "_test")


def split_stats(df: DataFrame, spec: AuditSpec, split: str = "split") -> DataFrame:
    """Size and class counts per split."""
    return df.groupBy(split, spec.label).agg(F.count(F.lit(1)).alias("n"))


def kfold(df: DataFrame, spec: AuditSpec, k: int = CV_FOLDS, out: str = "fold") -> DataFrame:
    """K folds stratified on the label only, by a second seeded hash: the
    hashes up to which n / k, 2 n / k, ... rows of a label lie cut it into
    folds whose sizes differ by one at most. All rows are decided by comparison
    with their label's k - 1 cuts; only boundary buckets are ranked. Rows that
    repeat an id share a fold; a null label is a stratum of its own."""
    hashed = df.withColumn("_h", md5_key(spec.id, FOLD_SALT))
    cuts = hash_cuts(hashed, [spec.label], "_h", [F.floor(F.col("_n") * f / k).cast("bigint") for f in range(1, k)])
    table = cuts.groupBy(F.col(spec.label).alias("_b_label")).agg(*[F.max(F.when(F.col("_i") == f - 1, F.col("_cut"))).alias(f"_cut{f}") for f in range(1, k)])
    joined = hashed.join(write_once(table, "fold-cuts"), F.col(spec.label).eqNullSafe(F.col("_b_label")), "left")
    # a cut that takes no rows has no hash: every row lies above it
    above = [F.coalesce(F.col("_h") > F.col(f"_cut{f}"), F.lit(True)).cast("int") for f in range(1, k)]
    return joined.withColumn(out, sum(above, F.lit(0))).drop("_h", "_b_label", *[f"_cut{f}" for f in range(1, k)])


def undersample(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """Class balance by undersampling: every class keeps as many rows as
    the smallest class has, chosen by seeded hash order (reproducible in SQL,
    unlike ``sampleBy``). This is the sampling operator itself."""
    y = spec.label
    labelled = df.where(F.col(y).isNotNull()).withColumn("_h", md5_key(spec.id, SAMPLE_SALT))
    n_min = labelled.groupBy(y).count().agg(F.min("count")).first()[0] or 0   # one number
    cuts = hash_cuts(labelled, [y], "_h", F.lit(n_min).cast("bigint"))
    return below_cut(labelled, cuts, [y], "_h", "_in").where("_in").drop("_h", "_in")
