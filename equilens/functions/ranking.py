"""Distributed running totals and exact hash ranks.

Ranking metrics (ROC-AUC, average precision), the threshold sweep and the
exact stratified split all need a running count in a global order. A plain
``Window.orderBy`` without ``partitionBy`` moves every row into one task, so
both helpers work in two levels:

1. split the ordered key space into buckets of bounded size,
2. total each bucket (a table of at most keys x buckets rows), turn the
   totals into bucket offsets with a window over that small table,
3. add each row's running sum inside its bucket to the bucket offset.

No step holds more than one bucket in one task, and skew on a single score or
stratum cannot concentrate rows: scores are first collapsed to distinct values
(map-side partial aggregation), and hash buckets are uniform by construction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import write_once


#: Distinct values that one bucket should hold.
BUCKET_ROWS = 250_000


def running_totals(df: DataFrame, keys: Sequence[str], order_col: str, value_cols: Sequence[str],
                   descending: bool = True, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<v>`` = inclusive running sum of ``v`` within ``keys``, in
    ``order_col`` order. ``order_col`` must be distinct within ``keys``
    (collapse first). Nulls come first in ascending order, NaN last.

    The collapsed table is written once; up to ``BUCKET_ROWS`` rows it is one
    bucket, summed in place. Beyond that numbers get fixed bucket edges from one
    aggregate, so a row's bucket is an expression of its value and any
    evaluation agrees with any other: the rows are shuffled once, by (keys,
    bucket), and only the bucket totals beside them. Text has no such edges; it
    is range-partitioned and written with its partition as bucket, since range
    bounds are sampled anew at every evaluation.
    """
    keys = list(keys)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    values = write_once(df, "values")   # the number of buckets follows its rows
    nb = max(1, -(-values.count() // BUCKET_ROWS))
    if nb == 1:
        whole = Window.partitionBy(*keys or [F.lit(0)]).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return values.select("*", *[F.sum(v).over(whole).alias(f"{prefix}{v}") for v in value_cols])
    if isinstance(values.schema[order_col].dataType, NumericType):
        cut, upward = by_edges(values, order_col, nb), not descending
    else:
        cut, upward = write_once(values.repartitionByRange(nb, *[F.col(k) for k in keys], order)
                                 .withColumn("_bucket", F.spark_partition_id()), "ranged"), True
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    bucket = F.col("_bucket").asc() if upward else F.col("_bucket").desc()
    wo = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # a row a bucket and key: Spark plans the join to the rows' layout by its size
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"),
                            *[F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    laid = cut.repartition(*[F.col(k) for k in keys], F.col("_bucket"))
    wi = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = laid.select("*", *[F.sum(v).over(wi).alias(f"_i_{v}") for v in value_cols])
    same = F.col("_bucket") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return inside.join(offsets, same).select(*values.columns, *[(F.col(f"_i_{v}") + F.col(f"_o_{v}")).alias(f"{prefix}{v}") for v in value_cols])


def by_edges(values: DataFrame, col: str, buckets: int) -> DataFrame:
    """``values`` with ``_bucket``: ascending buckets of about equal rows, cut at values that one aggregate of bounded
    size finds (``buckets`` - 1 numbers on the driver). Nulls are in bucket -1, NaN in the last."""
    x = F.col(col).cast("double")
    at = [i / buckets for i in range(1, buckets)]
    found = values.where(~F.isnan(x)).agg(F.percentile_approx(x, at, max(10_000, 10 * buckets))).first()[0] or []
    edges = sorted({e for e in found if math.isfinite(e)})
    binned = Bucketizer(splits=[-math.inf, *(edges or [0.0]), math.inf], inputCol="_x", outputCol="_b", handleInvalid="keep") \
        .transform(values.withColumn("_x", F.coalesce(x, F.lit(0.0))))
    return binned.withColumn("_bucket", F.when(x.isNull(), F.lit(-1)).otherwise(F.col("_b").cast("int"))).drop("_x", "_b")


def hash_rank(df: DataFrame, strata: Sequence[str], hash_col: str, rank_col: str = "rank",
              digits: int = 4) -> DataFrame:
    """Exact 1-based rank of each row within ``strata`` by ``hash_col`` (a hex
    md5 string; ties only for equal inputs), plus ``<rank_col>_of``: the
    stratum size, taken from the same bucket table (no second aggregate).

    Rows fall into 16**digits hash buckets; bucket counts per stratum (at most
    strata x 65,536 rows) give offsets, and only rows of one bucket are ever
    sorted together. A stratum holding a third of all rows is therefore spread
    over 65,536 independent window partitions instead of one.
    """
    strata = list(strata)
    b = F.substring(F.col(hash_col), 1, digits)
    hb = df.withColumn("_hb", b)
    counts = hb.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    wo = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))) \
        .orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    offsets = counts.select(*strata, "_hb", F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"),
                            F.sum("_n").over(wt).alias(f"{rank_col}_of"))
    wi = Window.partitionBy(*strata, "_hb").orderBy(F.col(hash_col))
    return (hb.join(offsets, [*strata, "_hb"])
              .withColumn(rank_col, (F.row_number().over(wi) + F.col("_off")).cast("bigint"))
              .drop("_hb", "_off"))


def hash_cuts(df: DataFrame, strata: Sequence[str], hash_col: str, wanted: Column | list[Column], digits: int = 4) -> DataFrame:
    """(strata..., ``_cut``, ``_i``): the hash up to which ``wanted`` rows of a stratum lie (``wanted`` is an
    expression of ``_n``, the stratum's size, or an array of them, numbered by ``_i``); where none are wanted
    there is no row.

    Counts per (stratum, hash bucket) find the one bucket a stratum's cut falls into; only the hashes
    of these buckets are ranked. The rows themselves are decided by comparison, without a shuffle.
    """
    strata = list(strata)
    hashes = df.select(*strata, F.col(hash_col).alias("_hash"), F.substring(F.col(hash_col), 1, digits).alias("_hb"))
    counts = hashes.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_in"))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_in").over(whole.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = counts.select(*strata, "_hb", "_in", before.alias("_before"), F.sum("_in").over(whole).alias("_n")) \
        .select("*", F.posexplode(F.array(*(wanted if isinstance(wanted, list) else [wanted]))).alias("_i", "_k")).where((F.col("_k") > F.col("_before")) & (F.col("_k") <= F.col("_before") + F.col("_in")))
    found = write_once(found.select(*[F.col(c).alias(f"_b_{c}") for c in strata], F.col("_hb").alias("_b_hb"), "_i",
                                    (F.col("_k") - F.col("_before")).alias("_need")), "boundaries")
    same = F.col("_hb") == F.col("_b_hb")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    nth = F.row_number().over(Window.partitionBy("_i", *strata, "_hb").orderBy("_hash"))
    return (hashes.join(found, same).withColumn("_nth", nth).where(F.col("_nth") == F.col("_need"))
            .select(*strata, F.col("_hash").alias("_cut"), "_i"))


def below_cut(df: DataFrame, cuts: DataFrame, strata: Sequence[str], hash_col: str, out: str) -> DataFrame:
    """``df`` with the flag ``out``: the row's hash lies within its stratum's cut. The table of cuts (one row
    a stratum) is written, so the join is planned by its true size."""
    table = write_once(cuts.select(*[F.col(c).alias(f"_b_{c}") for c in strata], "_cut"), "cuts")
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    flag = F.coalesce(F.col(hash_col) <= F.col("_cut"), F.lit(False))
    return df.join(table, same, "left").withColumn(out, flag).drop("_cut", *[f"_b_{c}" for c in strata])


def collapse_scores(df: DataFrame, score: str, label: str, keys: Sequence[str] = (),
                    weight: str | None = None, positive: int = 1) -> DataFrame:
    """One row per (keys, distinct score) with positive/negative counts
    (weighted sums when ``weight`` is set); NULL scores or labels excluded."""
    y = F.col(label)
    one = F.lit(1) if weight is None else F.col(weight)
    zero = F.lit(0) if weight is None else F.lit(0.0)
    return (df.where(F.col(score).isNotNull() & y.isNotNull())
              .groupBy(*keys, F.col(score).alias("s"))
              .agg(F.sum(F.when(y == positive, one).otherwise(zero)).alias("pos"),
                   F.sum(F.when(y != positive, one).otherwise(zero)).alias("neg")))

