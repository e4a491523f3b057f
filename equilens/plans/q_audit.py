"""Registered queries: group audit."""

from __future__ import annotations

from ..operators import audit as au
from ..sources.frames import PRICE_LABELS, decision_frame, document_frame
from ..spec import DECISIONS
from .registry import register
from .sqlframes import DECISIONS as D, DOCUMENTS, with_

AUDIT_ATTRS = ("segment", "price_band", "region")
BAND_NAMES = ("rate_0_100k", "rate_100k_200k", "rate_200k_300k", "rate_300k_400k", "rate_400k_plus")


@register("overall_rate", with_(D) + """
SELECT CAST(count_if(y IS NOT NULL) AS BIGINT) AS n, CAST(count_if(y = 1) AS BIGINT) AS n_default,
       round(CAST(count_if(y = 1) AS DOUBLE) / CAST(count_if(y IS NOT NULL) AS DOUBLE), 6) AS default_rate,
       round(1 - CAST(count_if(y = 1) AS DOUBLE) / CAST(count_if(y IS NOT NULL) AS DOUBLE), 6) AS approval_rate
FROM d""", rows="B1")
def q_overall_rate(spark, sf):
    return au.overall_rate(decision_frame(spark, sf), DECISIONS)


GROUP_RATES_SQL = """,
gs AS (
  SELECT CASE WHEN grouping(segment) = 0 THEN 'segment' WHEN grouping(price_band) = 0 THEN 'price_band'
              WHEN grouping(region) = 0 THEN 'region' ELSE 'overall' END AS attribute,
         CASE WHEN grouping(segment) = 0 THEN CAST(segment AS VARCHAR)
              WHEN grouping(price_band) = 0 THEN CAST(price_band AS VARCHAR)
              WHEN grouping(region) = 0 THEN CAST(region AS VARCHAR) ELSE 'all' END AS value,
         CAST(count_if(y IS NOT NULL) AS BIGINT) AS n, CAST(count_if(y = 1) AS BIGINT) AS dflt
  FROM d GROUP BY GROUPING SETS ((segment), (price_band), (region), ())),
gr AS (
  SELECT attribute, value, n,
         round(CASE WHEN n <> 0 THEN CAST(dflt AS DOUBLE) / CAST(n AS DOUBLE) END * 100, 6) AS default_rate_pct,
         round(100 - CASE WHEN n <> 0 THEN CAST(dflt AS DOUBLE) / CAST(n AS DOUBLE) END * 100, 6) AS approval_rate_pct
  FROM gs)"""


@register("group_rates", with_(D) + GROUP_RATES_SQL + "\nSELECT * FROM gr", rows="B2")
def q_group_rates(spark, sf):
    return au.group_rates(decision_frame(spark, sf), DECISIONS, AUDIT_ATTRS)


@register("crosstab_norm", with_(D) + """
SELECT g, CAST(count_if(y = 0) + count_if(y = 1) AS BIGINT) AS n,
       round(CAST(count_if(y = 0) AS DOUBLE) / CAST(count_if(y = 0) + count_if(y = 1) AS DOUBLE), 6) AS share_y0,
       round(CAST(count_if(y = 1) AS DOUBLE) / CAST(count_if(y = 0) + count_if(y = 1) AS DOUBLE), 6) AS share_y1
FROM d WHERE y IS NOT NULL AND g IS NOT NULL GROUP BY g""", rows="B3")
def q_crosstab_norm(spark, sf):
    return au.crosstab_norm(decision_frame(spark, sf), DECISIONS)


@register("intersection_grid", with_(D) + """
SELECT segment,
""" + ",\n".join(
    f"  round(avg(CASE WHEN price_band = '{v}' THEN CAST(y AS DOUBLE) END), 6) AS {n}"
    for v, n in zip(PRICE_LABELS, BAND_NAMES)) + """
FROM d WHERE y IS NOT NULL AND segment IS NOT NULL GROUP BY segment""", rows="B5")
def q_intersection_grid(spark, sf):
    return au.intersection_grid(decision_frame(spark, sf), DECISIONS, "segment", "price_band",
                                PRICE_LABELS, BAND_NAMES)


@register("intersection_extremes", with_(DOCUMENTS) + """,
cells AS (
  SELECT lang || '/' || source AS cell, CAST(count(*) AS BIGINT) AS n,
         CAST(count_if(y = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS default_rate
  FROM docs WHERE y IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL GROUP BY lang, source),
lo AS (SELECT default_rate AS r, cell FROM cells WHERE n >= 5 ORDER BY default_rate, cell LIMIT 1),
hi AS (SELECT default_rate AS r, cell FROM cells WHERE n >= 5 ORDER BY default_rate DESC, cell LIMIT 1)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM cells WHERE n >= 5) AS n_cells,
       (SELECT CAST(count(*) AS BIGINT) FROM cells WHERE n < 5) AS n_excluded_cells,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM cells WHERE n < 5) AS n_excluded_rows,
       round(lo.r, 6) AS min_rate, lo.cell AS min_cell, round(hi.r, 6) AS max_rate, hi.cell AS max_cell,
       round((hi.r - lo.r) * 100, 6) AS disparity_points
FROM lo, hi""", rows="B6")
def q_intersection_extremes(spark, sf):
    return au.intersection_extremes(document_frame(spark, sf), DECISIONS, "lang", "source", min_cell=5)


@register("composition", with_(D) + """,
t AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(g = 1) AS BIGINT) AS privileged,
             CAST(count_if(g <> 1) AS BIGINT) AS unprivileged, CAST(count_if(y = 0) AS BIGINT) AS good,
             CAST(count_if(y <> 0) AS BIGINT) AS bad FROM d)
SELECT category, n, round(CAST(n AS DOUBLE) * 100.0 / CAST(total AS DOUBLE), 1) AS percentage FROM (
  SELECT 'privileged' AS category, privileged AS n, total FROM t
  UNION ALL SELECT 'unprivileged', unprivileged, total FROM t
  UNION ALL SELECT 'good', good, total FROM t
  UNION ALL SELECT 'bad', bad, total FROM t)""", rows="B7 F4")
def q_composition(spark, sf):
    return au.composition(decision_frame(spark, sf), DECISIONS)


IMPACT_ATTRS = ("segment", "price_band", "region", "nation", "priority")


@register("attribute_impact", with_(D) + """,
gs AS (
  SELECT CASE WHEN grouping(segment) = 0 THEN 'segment' WHEN grouping(price_band) = 0 THEN 'price_band'
              WHEN grouping(region) = 0 THEN 'region' WHEN grouping(nation) = 0 THEN 'nation'
              WHEN grouping(priority) = 0 THEN 'priority' ELSE 'overall' END AS attribute,
         CAST(count_if(y IS NOT NULL) AS BIGINT) AS n, CAST(count_if(y = 1) AS BIGINT) AS dflt
  FROM d GROUP BY GROUPING SETS ((segment), (price_band), (region), (nation), (priority), ())),
gr AS (SELECT attribute, CASE WHEN n <> 0 THEN CAST(dflt AS DOUBLE) / CAST(n AS DOUBLE) END * 100 AS r
       FROM gs WHERE attribute <> 'overall')
SELECT attribute, CAST(count(*) AS BIGINT) AS n_values, round(min(r), 6) AS min_default_rate_pct,
       round(max(r), 6) AS max_default_rate_pct, round(max(r) - min(r), 6) AS spread_points,
       round(CASE WHEN max(r) <> 0 THEN min(r) / max(r) END, 6) AS min_max_ratio
FROM gr GROUP BY attribute""", rows="B8")
def q_attribute_impact(spark, sf):
    return au.attribute_impact(decision_frame(spark, sf), DECISIONS, IMPACT_ATTRS)


@register("bias_verdict", with_(D) + """,
a AS (SELECT count_if(y = 0 AND g = 1) / nullif(count_if(y IS NOT NULL AND g = 1), 0) AS rp,
             count_if(y = 0 AND g <> 1) / nullif(count_if(y IS NOT NULL AND g <> 1), 0) AS ru FROM d),
b AS (SELECT rp, ru, CASE WHEN rp <> 0 THEN ru / rp END AS ratio FROM a)
SELECT round(ratio, 6) AS approval_ratio,
       CASE WHEN ratio IS NULL THEN 'undefined' WHEN ratio < 0.8 THEN 'below_band' WHEN ratio > 1.25 THEN 'above_band'
            ELSE 'in_band' END AS verdict,
       CASE WHEN ratio IS NULL THEN 'undefined' WHEN ratio >= 0.8 AND ratio <= 1.25 THEN 'band_kept' ELSE 'band_left' END AS di_status,
       CASE WHEN ru - rp IS NULL THEN 'undefined' WHEN ru - rp < 0 THEN 'favours_privileged'
            WHEN ru - rp > 0 THEN 'favours_unprivileged' ELSE 'no_difference' END AS spd_direction
FROM b""", rows="B9")
def q_bias_verdict(spark, sf):
    return au.bias_verdict(decision_frame(spark, sf), DECISIONS)


@register("subgroup_cube", with_(D) + """
SELECT segment, region, priority, CAST(grouping(segment, region, priority) AS INTEGER) AS grouping_id,
       CAST(count_if(y IS NOT NULL) AS BIGINT) AS n,
       round(CASE WHEN count_if(y IS NOT NULL) <> 0
                  THEN CAST(count_if(y = 1) AS DOUBLE) / CAST(count_if(y IS NOT NULL) AS DOUBLE) END, 6) AS default_rate,
       count_if(y IS NOT NULL) < 30 AS small_cell
FROM d GROUP BY CUBE (segment, region, priority)""", rows="B10")
def q_subgroup_cube(spark, sf):
    return au.subgroup_cube(decision_frame(spark, sf), DECISIONS, ("segment", "region", "priority"), min_cell=30)


@register("document_group_rates", with_(DOCUMENTS) + """,
gs AS (
  SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS attribute,
         CASE WHEN grouping(lang) = 0 THEN CAST(lang AS VARCHAR) WHEN grouping(source) = 0 THEN CAST(source AS VARCHAR)
              ELSE 'all' END AS value,
         CAST(count_if(y IS NOT NULL) AS BIGINT) AS n, CAST(count_if(y = 1) AS BIGINT) AS dflt
  FROM docs GROUP BY GROUPING SETS ((lang), (source), ()))
SELECT attribute, value, n,
       round(CASE WHEN n <> 0 THEN CAST(dflt AS DOUBLE) / CAST(n AS DOUBLE) END * 100, 6) AS default_rate_pct,
       round(100 - CASE WHEN n <> 0 THEN CAST(dflt AS DOUBLE) / CAST(n AS DOUBLE) END * 100, 6) AS approval_rate_pct
FROM gs""", rows="B2")
def q_document_group_rates(spark, sf):
    return au.group_rates(document_frame(spark, sf), DECISIONS, ("lang", "source"))
