"""Registered queries: the raw-file job (S1-S3, E1-E6). The raw file is written by Spark from the
orders and customers; some of its lines are spoilt, by their own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..raw_audit import run_raw_audit
from ..session import scratch_path
from ..sources.tables import read_table
from .registry import register

#: Raw fields from an order's and its customer's values, in the file's order (both engines read them).
FIELDS = {
    "status": "concat('A1', 1 + id % 4)", "duration": "1 + id % 72", "credit_history": "concat('A3', id % 5)",
    "purpose": "concat('A4', id % 11)", "amount": "floor(price)", "savings": "concat('A6', 1 + id % 5)",
    "employment_duration": "concat('A7', 1 + cust % 5)", "installment_rate": "1 + id % 4",
    "personal_status_sex": "concat('A9', 1 + cust % 6)", "other_debtors": "concat('A10', 1 + id % 3)",
    "present_residence": "1 + cust % 4", "property": "concat('A12', 1 + id % 4)", "age": "18 + cust % 90",
    "other_installment_plans": "concat('A14', 1 + id % 3)", "housing": "concat('A15', 1 + cust % 3)",
    "number_credits": "1 + id % 4", "job": "concat('A17', 1 + id % 4)", "people_liable": "1 + id % 2",
    "telephone": "concat('A19', 1 + cust % 2)", "foreign_worker": "concat('A20', 1 + id % 2)",
    "credit_risk": "CASE WHEN fate = 'F' THEN 2 WHEN fate = 'O' THEN 1 ELSE 3 END",
}
NO_NUMBER = "priority = '1-URGENT' AND id % 11 = 0"      # the amount is no number
CUT_SHORT = "priority = '2-HIGH' AND id % 13 = 0"        # the last fields are missing
TEXT = [c for c, e in FIELDS.items() if e.startswith("concat")]

ROWS = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price, o_orderstatus AS fate, o_orderpriority AS priority FROM orders"
LINE = "concat_ws(' ', " + ", ".join(f"CAST({'amount_text' if c == 'amount' else c} AS VARCHAR)" for c in FIELDS) + ")"


def raw_file(spark, sf: str) -> str:
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]) \
        .toDF("id", "cust", "price", "fate", "priority")
    fields = {c: F.expr(e).cast("bigint" if c == "amount" else "string").cast("string") for c, e in FIELDS.items()}
    fields["amount"] = F.when(F.expr(NO_NUMBER), F.lit("n/a")).otherwise(fields["amount"])
    short = F.concat_ws(" ", *list(fields.values())[:-3])
    path = scratch_path(spark, "raw-file")
    o.select(F.when(F.expr(CUT_SHORT), short).otherwise(F.concat_ws(" ", *fields.values())).alias("value")).write.text(path)
    return path


SPOILT = "WITH o AS (" + ROWS + "),\nraw AS (SELECT o.*, " + ", ".join(
    f"CAST({e} AS {'VARCHAR' if c in TEXT else 'INTEGER'}) AS {c}" for c, e in FIELDS.items()) + " FROM o),\n" + f"""
bad AS (SELECT *, CASE WHEN {NO_NUMBER} THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS amount_text FROM raw WHERE ({NO_NUMBER}) OR ({CUT_SHORT})),
good AS (SELECT * FROM raw WHERE NOT (({NO_NUMBER}) OR ({CUT_SHORT})))"""


@register("raw_quarantine", SPOILT + f"""
SELECT CASE WHEN {CUT_SHORT} THEN {LINE.rsplit(", ", 3)[0]}) ELSE {LINE} END AS line FROM bad""", rows="S1")
def q_raw_quarantine(spark, sf):
    """Bad lines of the raw file, as they stand in it."""
    return run_raw_audit(spark, raw_file(spark, sf), scratch_path(spark, "raw-audit"))["quarantine"]


@register("raw_audit", SPOILT + "\nSELECT " + ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" if c in TEXT else
    "CASE credit_risk WHEN 1 THEN 0 WHEN 2 THEN 1 END AS credit_risk" if c == "credit_risk" else c for c in FIELDS) + """,
       CASE WHEN personal_status_sex IN ('A91', 'A93', 'A94') THEN 1 WHEN personal_status_sex IN ('A92', 'A95') THEN 0 END AS gender,
       CASE WHEN age > 18 AND age <= 25 THEN '18-25' WHEN age > 25 AND age <= 35 THEN '26-35' WHEN age > 35 AND age <= 45 THEN '36-45'
            WHEN age > 45 AND age <= 55 THEN '46-55' WHEN age > 55 AND age <= 100 THEN '55+' END AS age_group
FROM good""", rows="S1 S2 S3 E1 E2 E4 E5 E6")
def q_raw_audit(spark, sf):
    """The numeric table of the whole chain."""
    return run_raw_audit(spark, raw_file(spark, sf), scratch_path(spark, "raw-audit"))["numeric"]
