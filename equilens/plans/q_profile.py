"""Registered queries: profiling (P1-P7), encoding and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as en
from ..operators import profile as pf
from ..operators import validate as va
from ..sources.frames import FEATURES, decision_frame
from ..sources.tables import read_table
from .registry import register
from .sqlframes import DECISIONS as D, LINES, with_

FRAME_COLS = ("id", "y", "g", "segment", "region", "nation", "priority", "price_band", "o_totalprice",
              "c_acctbal", "p", "pred", "n_lines", "qty_sum", "avg_discount")
CATEGORICAL = ("segment", "region", "priority", "price_band")

# --- fixed values: dictionaries and range rules of the test frames ---------
STATUS_DICTIONARY = (("F", "fulfilled"), ("O", "open"), ("P", "partially fulfilled"),
                     ("X", "cancelled (documented, unused)"))
SEGMENT_GROUPS = (("BUILDING", "privileged"), ("MACHINERY", "privileged"), ("AUTOMOBILE", "unprivileged"),
                  ("FURNITURE", "unprivileged"), ("HOUSEHOLD", "unprivileged"))
RULES = (va.Rule("o_totalprice", 1, 500000, True), va.Rule("c_acctbal", 0, 10000, True),
         va.Rule("n_lines", 1, 7, True), va.Rule("avg_discount", 0, 0.1, False),
         va.Rule("qty_sum", 1, 350, False))
# ---------------------------------------------------------------------------


def _feat(spark, sf):
    return decision_frame(spark, sf, features=True).select(*FRAME_COLS)


def _union(parts):
    return "\n  UNION ALL ".join(parts)


#: The contract of the feature frame, and its types in the oracle's terms.
FRAME_TYPES = dict.fromkeys(FRAME_COLS, "double") | dict.fromkeys(("segment", "region", "nation", "priority", "price_band"), "string") \
    | dict.fromkeys(("y", "g", "pred"), "int") | dict.fromkeys(("id", "n_lines"), "bigint")
SQL_TYPES = {"double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT"}


@register("profile_shape", with_(D, LINES) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, 15 AS n_columns, 10 AS n_numeric, 5 AS n_string FROM df""",
          rows="P1 P5")
def q_profile_shape(spark, sf):
    return pf.profile_shape(_feat(spark, sf))


@register("profile_nulls", with_(D, LINES) + """,
nn AS (""" + _union([f"SELECT '{c}' AS column, CAST(count_if({c} IS NULL) AS BIGINT) AS n_null FROM df"
                     for c in FRAME_COLS]) + """)
SELECT "column", n_null FROM nn WHERE n_null > 0""", rows="P2 F5")
def q_profile_nulls(spark, sf):
    return pf.profile_nulls(_feat(spark, sf))


@register("value_counts", with_(D) + _union(
    [f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY {c}"
     for c in CATEGORICAL]), rows="P3 K6")
def q_value_counts(spark, sf):
    return pf.value_counts(decision_frame(spark, sf), CATEGORICAL)


@register("describe_numeric", with_(D, LINES) + _union([f"""
SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(min(CAST({c} AS DOUBLE)), 6) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, round(max(CAST({c} AS DOUBLE)), 6) AS max
FROM df""" for c in FEATURES]), rows="P4")
def q_describe_numeric(spark, sf):
    return pf.describe_numeric(_feat(spark, sf), FEATURES)


@register("contract_checks", with_(D, LINES) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS expected_rows,
       count(*) = (SELECT count(*) FROM orders) AS rows_ok, CAST(""" + str(len(FRAME_COLS)) + """ AS INTEGER) AS n_columns,
       coalesce(concat_ws(',', """ + ", ".join(f"CASE WHEN any_value(typeof({c})) <> '{SQL_TYPES[FRAME_TYPES[c]]}' THEN '{c}' END" for c in sorted(FRAME_COLS)) + """), '') AS wrong_columns,
       """ + " AND ".join(f"any_value(typeof({c})) = '{SQL_TYPES[FRAME_TYPES[c]]}'" for c in FRAME_COLS) + """ AS columns_ok,
       CAST(coalesce(sum(""" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in FRAME_COLS) + """), 0) AS BIGINT) AS null_cells,
       CAST(count_if(y IS NULL OR y NOT IN (0, 1)) AS BIGINT) AS bad_target,
       count_if(y IS NULL OR y NOT IN (0, 1)) = 0 AS target_domain_ok,
       round(CAST(count_if(y = 1) AS DOUBLE) / CAST(count_if(y IS NOT NULL) AS DOUBLE), 6) AS default_rate,
       coalesce(CAST(count_if(y = 1) AS DOUBLE) / CAST(count_if(y IS NOT NULL) AS DOUBLE) BETWEEN 0.2 AND 0.5, false)
         AS default_rate_ok
FROM df""", rows="P6")
def q_contract_checks(spark, sf):
    """One row an order, fifteen columns of given types: joins neither lose nor repeat orders."""
    return pf.contract_checks(_feat(spark, sf), "y", FRAME_TYPES, read_table(spark, sf, "orders", ["o_orderkey"]))


@register("feature_correlation", with_(D, LINES) + _union([f"""
SELECT '{c}' AS column, round(corr(CAST({c} AS DOUBLE), CAST(y AS DOUBLE)), 6) AS corr_with_label,
       CAST(count({c}) AS BIGINT) AS n FROM df""" for c in FEATURES]), rows="P7")
def q_feature_correlation(spark, sf):
    return pf.feature_correlation(_feat(spark, sf), FEATURES, "y")


@register("recode_target", """
SELECT o_orderkey AS id, o_orderstatus,
       CAST(CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderstatus = 'F' THEN 1 END AS INTEGER) AS y
FROM orders""", rows="E1")
def q_recode_target(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]).withColumnRenamed("o_orderkey", "id")
    return en.recode_target(o, "o_orderstatus", {"O": 0, "F": 1})


@register("derive_group", """
WITH dict(code, label) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in SEGMENT_GROUPS) + """)
SELECT o.o_orderkey AS id, c.c_mktsegment AS segment, dict.label AS group_label,
       CASE WHEN dict.label IS NOT NULL THEN CAST(dict.label = 'privileged' AS INTEGER) END AS g
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN dict ON c.c_mktsegment = dict.code""",
          rows="E2 E6")
def q_derive_group(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    df = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"),
                                                       F.col("c_mktsegment").alias("segment"))
    d = en.dictionary_frame(spark, SEGMENT_GROUPS, ["code", "label"])
    return en.derive_group(df, "segment", d, "privileged")


@register("code_dictionary", """
WITH dict(code, meaning) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in STATUS_DICTIONARY) + """),
cnt AS (SELECT o_orderstatus AS code, count(*) AS n FROM orders GROUP BY o_orderstatus)
SELECT dict.code, dict.meaning, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM dict LEFT JOIN cnt ON dict.code = cnt.code""", rows="E3")
def q_code_dictionary(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderstatus"])
    return en.code_dictionary(o, "o_orderstatus", en.dictionary_frame(spark, STATUS_DICTIONARY, ["code", "meaning"]))


@register("bin_right_closed", with_(D) + """
SELECT price_band, CAST(count(*) AS BIGINT) AS n, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price
FROM d GROUP BY price_band""", rows="E4")
def q_bin_right_closed(spark, sf):
    return decision_frame(spark, sf).groupBy("price_band").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"))


CODE_COLS = ("segment", "priority", "region")


@register("category_codes", with_(D) + "," + ",".join(f"""
c_{c} AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM d WHERE {c} IS NOT NULL))""" for c in CODE_COLS) + """
SELECT d.id, d.segment, d.priority, d.region, """ + ", ".join(
    f"coalesce(c_{c}.code, -1) AS {c}_code" for c in CODE_COLS) + """
FROM d """ + " ".join(f"LEFT JOIN c_{c} ON CAST(d.{c} AS VARCHAR) = c_{c}.v" for c in CODE_COLS), rows="E5")
def q_category_codes(spark, sf):
    df = decision_frame(spark, sf).select("id", *CODE_COLS)
    return en.category_codes(df, CODE_COLS)


def _viol_sql():
    parts = []
    for r in RULES:
        if r.required:
            parts.append(f"CASE WHEN {r.column} IS NULL THEN '{r.column}:required' END")
        if r.lower is not None:
            parts.append(f"CASE WHEN {r.column} < {r.lower} THEN '{r.column}:ge' END")
        if r.upper is not None:
            parts.append(f"CASE WHEN {r.column} > {r.upper} THEN '{r.column}:le' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


@register("validate_ranges", with_(D, LINES) + f""",
vv AS (SELECT id, {_viol_sql()} AS v FROM df)
SELECT id, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, ',') AS violations, len(v) = 0 AS valid
FROM vv""", rows="E15")
def q_validate_ranges(spark, sf):
    return va.validate_ranges(_feat(spark, sf), RULES, ["id"])


@register("validation_summary", with_(D, LINES) + f"""
SELECT rule, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_viol_sql()}) AS rule FROM df) GROUP BY rule""",
          rows="E16")
def q_validation_summary(spark, sf):
    return va.validation_summary(_feat(spark, sf), RULES)
