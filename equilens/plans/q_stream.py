"""Registered queries: streaming scoring, validation and windowed parity
(O7, O8, O9). Each runs a Structured Streaming query over the test table with
``availableNow`` and returns the sink table; the oracle is the batch SQL
(stream result = batch result)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, write_once
from ..operators import scoring as sc
from ..operators import thresholds as th
from ..sources.frames import FEATURES, decision_frame, decisions_from_orders
from ..sources.tables import read_table
from ..spec import DECISIONS
from ..streaming import monitor as mo
from . import q_mitigate as qm
from .registry import register
from .sqlframes import DECISIONS as D, EVENTS, with_

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _orders_stream(spark, sf):
    schema = read_table(spark, sf, "orders", ORDER_COLS).schema   # parquet footer only
    return mo.table_stream(spark, sf, "orders", schema).select(*ORDER_COLS)


@register("stream_score", with_(D, qm._threshold_sql("equal_opportunity")) + qm.APPLY_SQL + """
SELECT id, pred_adj AS prediction,
       CASE WHEN pred_adj = 0 THEN 'Good Credit' ELSE 'Default Risk' END AS prediction_label,
       round(p, 6) AS probability_default, round(1 - p, 6) AS probability_good,
       CASE WHEN p < 0.3 THEN 'Low' WHEN p < 0.6 THEN 'Medium' ELSE 'High' END AS risk_level,
       fairness_adjusted, '1.0.0' AS model_version
FROM ap""", rows="O7 S11")
def q_stream_score(spark, sf):
    # thresholds are fitted once in batch and materialised, so micro-batches
    # join a fixed small table instead of refitting
    thresholds = write_once(th.fit_thresholds(decision_frame(spark, sf), DECISIONS), "thresholds")
    stream = decisions_from_orders(spark, sf, _orders_stream(spark, sf))
    scored = sc.score_decisions(stream, DECISIONS, thresholds)
    return mo.run_available(spark, scored, "stream-score", "append")


@register("stream_validate", """
SELECT o.o_orderkey AS id, array_to_string(list_filter([
         CASE WHEN o.o_totalprice IS NULL THEN 'o_totalprice:required' END,
         CASE WHEN o.o_totalprice < 1 THEN 'o_totalprice:ge' END,
         CASE WHEN o.o_totalprice > 500000 THEN 'o_totalprice:le' END,
         CASE WHEN c.c_acctbal IS NULL THEN 'c_acctbal:required' END,
         CASE WHEN c.c_acctbal < 0 THEN 'c_acctbal:ge' END,
         CASE WHEN c.c_acctbal > 10000 THEN 'c_acctbal:le' END], lambda x: x IS NOT NULL), ',') AS violations
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""", rows="O9 E15")
def q_stream_validate(spark, sf):
    """Every streamed order: valid rows with empty violations, rejected ones (also those without a
    customer) with the rules they break."""
    from ..operators.validate import Rule
    rules = (Rule("o_totalprice", 1, 500000, True), Rule("c_acctbal", 0, 10000, True))
    c = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    stream = _orders_stream(spark, sf).join(c, F.col("o_custkey") == F.col("c_custkey"), "left") \
        .select(F.col("o_orderkey").alias("id"), "o_totalprice", "c_acctbal")
    valid, rejected = mo.validate_stream(spark, stream, rules, "stream-validate")
    return valid.select("id", F.lit("").alias("violations")).unionByName(
        rejected.select("id", F.array_join("violations", ",").alias("violations")))


def _window_sql(starts: list[str], width: str) -> str:
    blocks = "\n  UNION ALL ".join(f"SELECT {s} AS ws, y, g FROM ev" for s in starts)
    return with_(EVENTS) + f""",
ex AS ({blocks}),
agg AS (SELECT ws, CAST(count(*) AS BIGINT) AS n,
               CAST(count_if(g = 1) AS BIGINT) AS n_p, CAST(count_if(g = 1 AND y = 0) AS BIGINT) AS fav_p,
               CAST(count_if(g <> 1) AS BIGINT) AS n_u, CAST(count_if(g <> 1 AND y = 0) AS BIGINT) AS fav_u
        FROM ex GROUP BY ws)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL {width}, '%Y-%m-%d %H:%M:%S') AS window_end,
       n, n_u, n_p,
       round(CASE WHEN n_u <> 0 AND n_p <> 0 AND fav_p <> 0 THEN (fav_u / n_u) / (fav_p / n_p) END, 6) AS disparate_impact,
       round(CASE WHEN n_u <> 0 AND n_p <> 0 THEN fav_u / n_u - fav_p / n_p END, 6) AS statistical_parity_difference
FROM agg"""


@register("stream_tumbling", _window_sql(["date_trunc('day', ts)"], "1 DAY"), rows="O8")
def q_stream_tumbling(spark, sf):
    out = mo.window_parity(mo.event_stream(spark, sf), "1 day")
    return mo.run_available(spark, out, "stream-tumbling", "update", keys=["window_start", "window_end"])


@register("stream_sliding", _window_sql(["date_trunc('day', ts)", "date_trunc('day', ts) - INTERVAL 1 DAY"], "2 DAY"),
          rows="O8")
def q_stream_sliding(spark, sf):
    out = mo.window_parity(mo.event_stream(spark, sf), "2 days", "1 day")
    return mo.run_available(spark, out, "stream-sliding", "update", keys=["window_start", "window_end"])


@register("stream_session", with_(EVENTS) + """,
s1 AS (SELECT user_id, ts, y,
              CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                     OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS brk
       FROM ev),
s2 AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
       FROM s1)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
       strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS session_end,
       CAST(count(*) AS BIGINT) AS n_events, CAST(count_if(y = 1) AS BIGINT) AS n_errors
FROM s2 GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR""", rows="O8")
def q_stream_session(spark, sf):
    out = mo.session_activity(mo.event_stream(spark, sf), "10 minutes")
    # append mode: the sessions that the watermark (one hour behind the newest event) has closed
    return mo.run_available(spark, out, "stream-session", "append")


@register("stream_late", with_(EVENTS) + """,
top AS (SELECT max(ts) AS last FROM ev)
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(ts IS NULL) AS BIGINT) AS n_without_time,
       CAST(count_if(date_trunc('day', ts) + INTERVAL 1 DAY > last - INTERVAL 1 HOUR) AS BIGINT) AS n_counted,
       CAST(count_if(date_trunc('day', ts) + INTERVAL 1 DAY <= last - INTERVAL 1 HOUR) AS BIGINT) AS n_late
FROM ev, top""", rows="O8")
def q_stream_late(spark, sf):
    """Late rows as a number: the newest day's events arrive first, the older ones after the watermark has passed them."""
    e = read_table(spark, sf, "events", [f.name for f in mo.EVENT_SCHEMA.fields])
    folder, out, ckpt = (scratch_path(spark, f"late-{k}") for k in ("in", "out", "ckpt"))
    last = e.agg(F.max("ts")).first()[0]   # one value
    newest_day = F.coalesce(F.date_trunc("day", "ts") >= F.date_trunc("day", F.lit(last)), F.lit(False))
    first = newest_day & ((F.col("event_id") % 2 == 0) | (F.col("ts") == F.lit(last)))
    for part in (first, newest_day & ~first, ~newest_day):
        e.where(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(mo.EVENT_SCHEMA).parquet(folder)
        _, accounts = mo.window_parity_accounts(spark, mo.as_events(stream), "1 day", "late", out=out, ckpt=ckpt)
    return accounts


CUT_LINE = "priority = '1-URGENT' AND id % 7 = 0"        # requests whose text is cut short
NO_NUMBER = "priority = '2-HIGH' AND id % 5 = 0"         # requests with a word for a number


@register("stream_requests", with_(D) + f"""
SELECT CASE WHEN bad THEN NULL ELSE id END AS id,
       CASE WHEN bad THEN 'malformed' WHEN violations <> '' THEN 'rejected' ELSE 'scored' END AS status, violations,
       NOT bad AND violations = '' AS has_decision, bad AS has_line
FROM (SELECT id, ({CUT_LINE}) OR ({NO_NUMBER}) AS bad,
             CASE WHEN ({CUT_LINE}) OR ({NO_NUMBER}) THEN '' ELSE array_to_string(list_filter([
               CASE WHEN o_totalprice > 400000 THEN 'o_totalprice:le' END,
               CASE WHEN c_acctbal < 0 THEN 'c_acctbal:ge' END], lambda x: x IS NOT NULL), ',') END AS violations FROM d)""", rows="S11 O7 O9 H6 S7")
def q_stream_requests(spark, sf):
    """Requests as JSON lines, scored inside the stream by a saved and reloaded ``PipelineModel``."""
    # the joins and the line aggregate are made once, for the model and for the requests
    frame = write_once(decision_frame(spark, sf, features=True).select("id", "y", "g", "priority", *FEATURES), "decisions")
    path, lines = request_model(spark, sf, frame), scratch_path(spark, "requests")
    request_lines(spark, sf, frame).write.text(lines)
    return request_stream(spark, lines, path).select("id", "status", "violations", F.col("prediction").isNotNull().alias("has_decision"),
                                                     F.col("line").isNotNull().alias("has_line"))


REQUEST = "id bigint, g int, o_totalprice double, c_acctbal double, n_lines bigint, qty_sum double, avg_discount double"


def request_rules():
    from ..operators.validate import Rule
    return (Rule("o_totalprice", None, 400000, True), Rule("c_acctbal", 0, None, True))


def request_lines(spark, sf, frame=None):
    """The decision frame's rows as request lines (``value``), some of them spoilt."""
    df = decision_frame(spark, sf, features=True) if frame is None else frame
    fields = [c.split()[0] for c in REQUEST.split(", ")]
    whole = F.to_json(F.struct(*fields))
    word = F.to_json(F.struct(*[F.lit("many").alias(c) if c == "o_totalprice" else F.col(c) for c in fields]))
    return df.select(F.when(F.expr(CUT_LINE), F.substring(whole, 1, 20)).when(F.expr(NO_NUMBER), word).otherwise(whole).alias("value"))


def request_model(spark, sf, frame=None) -> str:
    """Folder of the fitted pipeline: preparation, logistic regression, group thresholds."""
    from ..operators import mitigate as mg
    from ..operators import search as se
    from ..operators.stages import audit_pipeline
    from .q_ml import BASELINES
    split = write_once(mg.holdout_exact(decision_frame(spark, sf, features=True) if frame is None else frame, DECISIONS).select("id", "y", "g", "split", *FEATURES), "split")
    train = split.where(F.col("split") == "train")
    lr = se.family_estimator(BASELINES[1][1], "features", "y", n_rows=se.total_weight(train, None))
    path = scratch_path(spark, "pipeline-model")
    audit_pipeline(FEATURES, lr, DECISIONS).fit(train).write().save(path)
    return path


def request_stream(spark, lines: str, model: str):
    """The rows of ``scoring.request_decisions`` for every line under ``lines``, by a stream."""
    from pyspark.ml import PipelineModel
    from pyspark.sql.types import StructType
    stream = sc.request_decisions(spark.readStream.text(lines), StructType.fromDDL(REQUEST), request_rules(), PipelineModel.load(model), "id")
    return mo.run_available(spark, stream, "stream-requests", "append")
