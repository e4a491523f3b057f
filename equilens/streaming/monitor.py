"""Structured Streaming: scoring, validation and windowed parity monitoring
(O7, O8, O9).

Parity over a window is a ratio of aggregates, so the streaming state holds
only counts per (window, group) and the ratios are computed at output time.
Event time arrives as TIMESTAMP_NTZ in the test tables; watermarks need
TIMESTAMP, so it is cast with the session time zone pinned to UTC.

Sinks: results go to parquet tables under the shared checkpoint folder (never
the driver): append-mode file sinks for row-level outputs and closed sessions,
per-epoch folders for update-mode aggregates. ``run_available`` drives a query with
``trigger(availableNow=True)`` and returns the sink table as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from ..functions.exprs import count_if, r6, safe_div
from ..session import scratch_path
from ..sources.store import path_exists

EVENT_SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("user_id", LongType()),
    StructField("event_type", StringType()), StructField("value", DoubleType()), StructField("props", StringType())])

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
TS_FORMAT_US = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table_stream(spark: SparkSession, sf_dir: str, table: str, schema: StructType,
                 max_files: int | None = None) -> DataFrame:
    """Stream the parquet file(s) of one table from a folder holding several."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event frame as a stream: ``id, ts (TIMESTAMP), user_id, y, g, value``."""
    return as_events(table_stream(spark, sf_dir, "events", EVENT_SCHEMA))


def as_events(e: DataFrame) -> DataFrame:
    """The event frame of rows of the events table, a table or a stream."""
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
                    (F.col("event_type") == "error").cast("int").alias("y"),
                    (F.col("user_id") % 2).cast("int").alias("g"), "value")


def parity_counts(favorable: int = 0, privileged: int = 1) -> list:
    y, g = F.col("y"), F.col("g")
    return [count_if(F.lit(True)).alias("n"),
            count_if(g == privileged).alias("n_p"), count_if((g == privileged) & (y == favorable)).alias("fav_p"),
            count_if(g.isNotNull() & (g != privileged)).alias("n_u"),
            count_if(g.isNotNull() & (g != privileged) & (y == favorable)).alias("fav_u")]


def parity_output(df: DataFrame, keys: list) -> DataFrame:
    """Ratios from the counts state; NULL when a window lacks one side."""
    ru, rp = safe_div(F.col("fav_u"), F.col("n_u")), safe_div(F.col("fav_p"), F.col("n_p"))
    return df.select(*keys, "n", "n_u", "n_p", r6(safe_div(ru, rp)).alias("disparate_impact"),
                     r6(ru - rp).alias("statistical_parity_difference"))


def window_parity(events: DataFrame, duration: str, slide: str | None = None,
                  watermark: str = "1 hour") -> DataFrame:
    """O8 tumbling (``slide`` None) or sliding windows of parity counts."""
    w = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    agg = events.withWatermark("ts", watermark).groupBy(w.alias("w")).agg(*parity_counts())
    out = agg.select(F.date_format("w.start", TS_FORMAT).alias("window_start"),
                     F.date_format("w.end", TS_FORMAT).alias("window_end"), "n", "n_u", "fav_u", "n_p", "fav_p")
    return parity_output(out, ["window_start", "window_end"])


def session_activity(events: DataFrame, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """O8 session windows per user: events and errors per session. For users
    with a large share of the events, submit the job with
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``:
    sessions are then merged inside each input partition first."""
    agg = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(
        F.count(F.lit(1)).alias("n_events"), count_if(F.col("y") == 1).alias("n_errors"))
    return agg.select("user_id", F.date_format("s.start", TS_FORMAT_US).alias("session_start"),
                      F.date_format("s.end", TS_FORMAT_US).alias("session_end"), "n_events", "n_errors")


def run_available(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append",
                  out: str | None = None, ckpt: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Run ``stream`` to the end of the available input (availableNow) into a
    parquet table under the shared checkpoint folder and return that table.

    append: file sink (exactly-once through the sink log);
    update: each micro-batch's changed rows go to a folder of its epoch
    (overwritten when the batch is replayed); the newest row of each of
    ``keys`` is returned, so nothing written earlier is lost and state is
    bounded by the watermark;
    complete: each micro-batch's complete result overwrites the table.
    Passing the same ``out`` / ``ckpt`` again resumes from the saved state.
    """
    out = out or scratch_path(spark, f"{name}-out")
    ckpt = ckpt or scratch_path(spark, f"{name}-ckpt")
    w = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    elif mode == "update":
        if not keys:
            raise ValueError("update mode needs the keys whose newest row counts")

        def epoch_sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        q = w.outputMode("update").foreachBatch(epoch_sink).start()
    elif mode == "complete":
        def sink(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = w.outputMode(mode).foreachBatch(sink).start()
    else:
        raise ValueError(mode)
    _finish(q)
    if not path_exists(spark, out):   # no trigger had any input
        return spark.createDataFrame([], stream.schema)
    result = spark.read.schema(StructType([*stream.schema.fields, StructField("epoch", LongType())]) if mode == "update" else stream.schema).parquet(out)
    if mode == "update":
        result = newest(result, keys)
    return result


def window_parity_accounts(spark: SparkSession, events: DataFrame, duration: str, name: str, slide: str | None = None, per_row: int = 1,
                           watermark: str = "1 hour", out: str | None = None, ckpt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """O8 with its losses counted: (windows, accounts). Each trigger's input is counted by ``observe`` before the
    watermark, read from the query's progress and written beside the windows, one row a trigger; runs that resume with
    the same ``out`` and ``ckpt`` add to it. The accounts have one row: ``n_rows`` read, ``n_without_time`` (in no
    window), ``n_counted`` and ``n_late`` (window memberships; a row is in ``per_row`` windows, duration / slide).
    ``n_late`` is what the watermark dropped: exact, since each membership is either counted or dropped."""
    out, ckpt = out or scratch_path(spark, f"{name}-out"), ckpt or scratch_path(spark, f"{name}-ckpt")
    seen = events.observe("arrived", F.count(F.lit(1)).alias("n_rows"), count_if(F.col("ts").isNull()).alias("n_without_time"))
    stream = window_parity(seen, duration, slide, watermark)

    def epoch_sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/windows/epoch={epoch}")

    q = stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).outputMode("update").foreachBatch(epoch_sink).start()
    arrived: dict[int, tuple[int, int]] = {}

    def harvest() -> None:
        for p in q.recentProgress:
            m = p.observedMetrics.get("arrived")
            if m is not None:
                arrived[p.batchId] = (m["n_rows"], m["n_without_time"])

    while not q.awaitTermination(1):   # the query keeps the newest 100 triggers only
        harvest()
    _finish(q)
    harvest()
    # a trigger whose run was cut off before its progress was read is written again by its replay
    for epoch, (n, none) in sorted(arrived.items()):
        spark.createDataFrame([(n, none)], "n_rows bigint, n_without_time bigint").coalesce(1).write.mode("overwrite").parquet(f"{out}/triggers/epoch={epoch}")
    schema = StructType([*stream.schema.fields, StructField("epoch", LongType())])
    # a stream without any file yet has no trigger, here or in an earlier run
    windows = (newest(spark.read.schema(schema).parquet(f"{out}/windows"), ["window_start", "window_end"])
               if path_exists(spark, f"{out}/windows") else spark.createDataFrame([], stream.schema))
    totals = (spark.read.schema("n_rows bigint, n_without_time bigint, epoch bigint").parquet(f"{out}/triggers")
              if path_exists(spark, f"{out}/triggers") else spark.createDataFrame([], "n_rows bigint, n_without_time bigint"))
    both = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_rows", "n_without_time")]).crossJoin(   # one row by one row
        windows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_counted")))
    return windows, both.select("n_rows", "n_without_time", "n_counted",
                                ((F.col("n_rows") - F.col("n_without_time")) * per_row - F.col("n_counted")).alias("n_late"))


def newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key from the latest epoch."""
    last = Window.partitionBy(*keys).orderBy(F.col("epoch").desc())
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "epoch")


def _finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def validate_stream(spark: SparkSession, stream: DataFrame, rules, name: str) -> tuple[DataFrame, DataFrame]:
    """Split every micro-batch into valid and rejected rows (with the
    broken rules) instead of failing on bad input. One write per batch, in
    folders by validity; a replayed batch overwrites its own epoch."""
    from ..operators.validate import violation_array
    out, ckpt = scratch_path(spark, f"{name}-rows"), scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, epoch: int) -> None:
        marked = batch.withColumn("violations", violation_array(rules))
        marked.withColumn("valid", F.size("violations") == 0).write.mode("overwrite") \
              .partitionBy("valid").parquet(f"{out}/epoch={epoch}")

    _finish(stream.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(sink).start())
    schema = StructType([*stream.schema.fields, StructField("violations", ArrayType(StringType())), StructField("valid", StringType())])
    rows = spark.read.schema(schema).parquet(out) if path_exists(spark, out) else spark.createDataFrame([], schema)
    rows = rows.withColumn("valid", F.col("valid").cast("boolean"))
    return rows.where("valid").drop("valid", "violations"), rows.where("not valid").drop("valid")
