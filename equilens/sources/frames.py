"""Decision, document and event frames derived from the test tables.

The audited data is a table of binary decisions with a protected attribute.
On the star-schema test tables it is built as (SURVEY 7.3):

* decision frame: one row per order; ``y`` = order fully shipped ('F') is the
  unfavourable outcome, ``g`` = customer segment BUILDING/MACHINERY is the
  privileged group, ``p`` a deterministic surrogate score with exact ties.
* document frame: labelled documents, ``y = 1 - quality``, groups lang/source.
* event frame: ``y`` = error event, ``g`` = user parity, event time ``ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import right_closed_bins
from .tables import read_table

# --- fixed values of the frame definitions --------------------------------
PRIVILEGED_SEGMENTS = ("BUILDING", "MACHINERY")
PRICE_EDGES = (0, 100000, 200000, 300000, 400000)
PRICE_LABELS = ("0-100k", "100k-200k", "200k-300k", "300k-400k", "400k+")
SCORE_MULT, SCORE_MOD, SCORE_Y, SCORE_G, SCORE_DEN = 7919, 1000, 400, 60, 1460
# ---------------------------------------------------------------------------

FEATURES = ("o_totalprice", "c_acctbal", "n_lines", "qty_sum", "avg_discount")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line aggregates (partial aggregation happens map-side)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_discount"])
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty_sum"),
        F.avg("l_discount").alias("avg_discount"),
    )


def decision_frame(spark: SparkSession, sf_dir: str, features: bool = False) -> DataFrame:
    """Decision frame: ``id, y, g, p, pred, segment, region, nation, priority,
    price_band, o_totalprice, c_acctbal`` (+ line features when asked).

    nation (25 rows) and region (5 rows) have a fixed size at every scale and
    are broadcast; orders and customer are large and join by key (AQE picks
    the strategy from runtime sizes). The line aggregate is already keyed by
    order, so its join reuses the aggregation's partitioning.
    """
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    return decisions_from_orders(spark, sf_dir, o, features)


def decisions_from_orders(spark: SparkSession, sf_dir: str, o: DataFrame, features: bool = False) -> DataFrame:
    """Decision frame from an orders DataFrame (a table or a stream: the joins
    to customer / nation / region are stream-static joins)."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    cust = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
             .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey))
    df = o.join(cust, o.o_custkey == cust.c_custkey)
    y = (F.col("o_orderstatus") == "F").cast("int")
    g = F.col("c_mktsegment").isin(*PRIVILEGED_SEGMENTS).cast("int")
    df = df.select(
        F.col("o_orderkey").alias("id"),
        y.alias("y"),
        g.alias("g"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"),
        right_closed_bins("o_totalprice", PRICE_EDGES, PRICE_LABELS, open_last=True).alias("price_band"),
        "o_totalprice", "c_acctbal",
        (((F.col("o_orderkey") * SCORE_MULT) % SCORE_MOD + SCORE_Y * y + SCORE_G * g).cast("double")
         / F.lit(float(SCORE_DEN))).alias("p"),
    )
    df = df.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    if features:
        lines = order_lines(spark, sf_dir)
        df = (df.join(lines, df.id == lines.l_orderkey, "left").drop("l_orderkey")
                .withColumn("n_lines", F.coalesce("n_lines", F.lit(0)).cast("bigint")))
    return df


def document_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: ``id, y, toxic, lang, source, n_chars``; ``y = 1 - quality``."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"),
        (F.lit(1) - F.col("quality")).cast("int").alias("y"),
        F.col("toxic").cast("int").alias("toxic"),
        "lang", "source", "n_chars")


def event_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: ``id, ts, user_id, y, g, value``; ``y`` = error event, ``g`` = user parity."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(
        F.col("event_id").alias("id"), "ts", "user_id",
        (F.col("event_type") == "error").cast("int").alias("y"),
        (F.col("user_id") % 2).cast("int").alias("g"),
        "value")
