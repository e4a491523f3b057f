"""The frames of ``sources.frames`` as SQL common table expressions, for the
DuckDB oracle statements. Integer arithmetic first, divide last, every rate
rounded to 6 decimals, counts cast to BIGINT: the same rules as the Spark side.
"""

from __future__ import annotations

import re

DECISIONS = """
d0 AS (
  SELECT o.o_orderkey AS id,
         CAST(o.o_orderstatus = 'F' AS INTEGER) AS y,
         CAST(c.c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER) AS g,
         c.c_mktsegment AS segment, r.r_name AS region, n.n_name AS nation,
         o.o_orderpriority AS priority,
         CASE WHEN o.o_totalprice > 0 AND o.o_totalprice <= 100000 THEN '0-100k'
              WHEN o.o_totalprice > 100000 AND o.o_totalprice <= 200000 THEN '100k-200k'
              WHEN o.o_totalprice > 200000 AND o.o_totalprice <= 300000 THEN '200k-300k'
              WHEN o.o_totalprice > 300000 AND o.o_totalprice <= 400000 THEN '300k-400k'
              WHEN o.o_totalprice > 400000 THEN '400k+' END AS price_band,
         o.o_totalprice, c.c_acctbal
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey),
d1 AS (
  SELECT *, CAST((id * 7919) % 1000 + 400 * y + 60 * g AS DOUBLE) / CAST(1460 AS DOUBLE) AS p FROM d0),
d AS (SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM d1)"""

LINES = """
li AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty_sum, avg(l_discount) AS avg_discount
  FROM lineitem GROUP BY l_orderkey),
df AS (
  SELECT d.*, CAST(coalesce(li.n_lines, 0) AS BIGINT) AS n_lines, li.qty_sum, li.avg_discount
  FROM d LEFT JOIN li ON li.l_orderkey = d.id)"""

DOCUMENTS = """
docs AS (
  SELECT d.doc_id AS id, CAST(1 - l.quality AS INTEGER) AS y, CAST(l.toxic AS INTEGER) AS toxic,
         d.lang, d.source, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

EVENTS = """
ev AS (
  SELECT event_id AS id, ts, user_id, CAST(event_type = 'error' AS INTEGER) AS y,
         CAST(user_id % 2 AS INTEGER) AS g, value
  FROM events)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def unrounded(sql: str) -> str:
    """The same columns without their final rounding, for statements that decide on them."""
    return re.sub(r"round\(((?:(?!round\().)*?), 6\) AS", r"\1 AS", sql, flags=re.DOTALL)
