"""Group audit aggregations.

Rates are algebraic, so every table here is a grouped aggregate with map-side
partial sums; several attributes are audited in one pass with grouping sets or
a cube instead of one scan per attribute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import count_if, r6, safe_div
from ..spec import DISPARATE_IMPACT_THRESHOLD, AuditSpec

# verdict codes of the approval ratio, and of the sign of the parity difference
VERDICT_BELOW = "below_band"
VERDICT_ABOVE = "above_band"
VERDICT_WITHIN = "in_band"
SPD_AGAINST_UNPRIV = "favours_privileged"
SPD_AGAINST_PRIV = "favours_unprivileged"
SPD_NONE = "no_difference"
UNDEFINED = "undefined"
DI_WITHIN, DI_OUTSIDE = "band_kept", "band_left"


def _default_rate(label: str) -> Column:
    y = F.col(label)
    return safe_div(count_if(y == 1), count_if(y.isNotNull()))


def overall_rate(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """B1: overall default rate and its complement, with the row count."""
    y = F.col(spec.label)
    agg = df.agg(count_if(y.isNotNull()).alias("n"), count_if(y == 1).alias("n_default"))
    rate = safe_div(F.col("n_default"), F.col("n"))
    return agg.select("n", "n_default", r6(rate).alias("default_rate"), r6(1 - rate).alias("approval_rate"))


def group_rates(df: DataFrame, spec: AuditSpec, attributes: Sequence[str], rounded: bool = True) -> DataFrame:
    """B2: default rate (percent) and count per value of every attribute, plus
    the overall row, from one grouping-sets aggregate (labelled by grouping()).
    Approval rate = 100 - default rate (SURVEY Q5)."""
    attrs = list(attributes)
    y = F.col(spec.label)
    sets = [[a] for a in attrs] + [[]]
    agg = df.groupingSets(sets, *attrs).agg(
        *[F.grouping(a).alias(f"_g_{a}") for a in attrs],
        count_if(y.isNotNull()).alias("n"), count_if(y == 1).alias("_d"))
    label = None
    value = None
    for a in attrs:
        cond = F.col(f"_g_{a}") == 0
        label = F.when(cond, F.lit(a)) if label is None else label.when(cond, F.lit(a))
        value = F.when(cond, F.col(a).cast("string")) if value is None else value.when(cond, F.col(a).cast("string"))
    rate = safe_div(F.col("_d"), F.col("n")) * 100
    return agg.select(label.otherwise(F.lit("overall")).alias("attribute"),
                      value.otherwise(F.lit("all")).alias("value"),
                      "n", (r6(rate) if rounded else rate).alias("default_rate_pct"),
                      (r6(100 - rate) if rounded else 100 - rate).alias("approval_rate_pct"))


def crosstab_norm(df: DataFrame, spec: AuditSpec, row: str | None = None) -> DataFrame:
    """Row-normalised crosstab row x label (share of label 0 and 1; 0 for
    empty cells). Pivot values are explicit, so no extra job finds them."""
    row = row or spec.group
    y = F.col(spec.label)
    agg = df.where(y.isNotNull() & F.col(row).isNotNull()).groupBy(row).agg(
        count_if(y == 0).alias("n0"), count_if(y == 1).alias("n1"))
    tot = F.col("n0") + F.col("n1")
    return agg.select(row, tot.alias("n"), r6(safe_div(F.col("n0"), tot)).alias("share_y0"),
                      r6(safe_div(F.col("n1"), tot)).alias("share_y1"))


def approval_gap(df: DataFrame, spec: AuditSpec, rounded: bool = True) -> DataFrame:
    """B4 (with F1 masks as conditional sums): approval rate of each side, the
    gap in percentage points (unprivileged - privileged) and the ratio."""
    y, g = F.col(spec.label), F.col(spec.group)
    priv = g == F.lit(spec.privileged)
    unpriv = g.isNotNull() & (g != F.lit(spec.privileged))
    ok = y.isNotNull()
    agg = df.agg(count_if(ok & priv).alias("_np"), count_if(ok & priv & (y == spec.favorable)).alias("_ap"),
                 count_if(ok & unpriv).alias("_nu"), count_if(ok & unpriv & (y == spec.favorable)).alias("_au"))
    rp, ru = safe_div(F.col("_ap"), F.col("_np")), safe_div(F.col("_au"), F.col("_nu"))
    shown = r6 if rounded else (lambda c: c)
    return agg.select(shown(rp).alias("approval_rate_privileged"), shown(ru).alias("approval_rate_unprivileged"),
                      shown((ru - rp) * 100).alias("gap_points"), shown(safe_div(ru, rp)).alias("approval_ratio"))


def _grid_long(df: DataFrame, spec: AuditSpec, rows: str, cols: str) -> DataFrame:
    y = F.col(spec.label)
    return (df.where(y.isNotNull() & F.col(rows).isNotNull() & F.col(cols).isNotNull())
              .groupBy(rows, cols)
              .agg(count_if(F.lit(True)).alias("n"), count_if(y == 1).alias("_d"))
              .withColumn("default_rate", safe_div(F.col("_d"), F.col("n"))))


def intersection_grid(df: DataFrame, spec: AuditSpec, rows: str, cols: str, values: Sequence[str],
                      names: Sequence[str] | None = None) -> DataFrame:
    """Rows x columns grid of default rates as a wide table. Pivot values
    are given, so Spark plans one aggregate and no job to discover them."""
    names = list(names or values)
    y = F.col(spec.label)
    wide = (df.where(y.isNotNull() & F.col(rows).isNotNull())
              .groupBy(rows).pivot(cols, list(values)).agg(F.avg(y.cast("double"))))
    return wide.select(rows, *[r6(F.col(v)).alias(nm) for v, nm in zip(values, names)])


def intersection_extremes(df: DataFrame, spec: AuditSpec, rows: str, cols: str, min_cell: int = 1) -> DataFrame:
    """Lowest and highest default rate over the grid cells with at least
    ``min_cell`` rows, the disparity in points and which cells (ties broken by
    the cell name), and how many smaller cells and rows that leaves out."""
    large = F.col("n") >= min_cell
    cells = _grid_long(df, spec, rows, cols).withColumn("cell", F.concat_ws("/", F.col(rows).cast("string"), F.col(cols).cast("string")))
    # ties broken by the cell name in both directions
    agg = cells.agg(F.min(F.when(large, F.struct(F.col("default_rate"), F.col("cell")))).alias("lo"),
                    F.min(F.when(large, F.struct((-F.col("default_rate")).alias("neg_rate"), F.col("cell")))).alias("hi"),
                    count_if(large).alias("n_cells"), count_if(~large).alias("n_excluded_cells"),
                    F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).cast("bigint").alias("n_excluded_rows"))
    return agg.select(
        "n_cells", "n_excluded_cells", "n_excluded_rows",
        r6(F.col("lo.default_rate")).alias("min_rate"), F.col("lo.cell").alias("min_cell"),
        r6(-F.col("hi.neg_rate")).alias("max_rate"), F.col("hi.cell").alias("max_cell"),
        r6((-F.col("hi.neg_rate") - F.col("lo.default_rate")) * 100).alias("disparity_points"))


def composition(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """Count and percent (1 decimal) of privileged, unprivileged, good and
    bad rows, unpivoted from one aggregate."""
    y, g = F.col(spec.label), F.col(spec.group)
    agg = df.agg(count_if(F.lit(True)).alias("total"),
                 count_if(g == F.lit(spec.privileged)).alias("privileged"),
                 count_if(g.isNotNull() & (g != F.lit(spec.privileged))).alias("unprivileged"),
                 count_if(y == spec.favorable).alias("good"),
                 count_if(y.isNotNull() & (y != spec.favorable)).alias("bad"))
    cats = ["privileged", "unprivileged", "good", "bad"]
    long = agg.select("total", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in cats])).alias("c"))
    return long.select("c.category", F.col("c.n").alias("n"),
                       F.round(F.col("c.n") * 100.0 / F.col("total"), 1).alias("percentage"))


def attribute_impact(df: DataFrame, spec: AuditSpec, attributes: Sequence[str]) -> DataFrame:
    """For every attribute, spread of the default rate across its values
    (max - min in points, min/max ratio). Built on B2's grouping-sets table;
    attributes that are proxies of the protected one show a large spread."""
    gr = group_rates(df, spec, attributes, rounded=False).where(F.col("attribute") != "overall")
    agg = gr.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_values"),
                                      F.min("default_rate_pct").alias("_lo"),
                                      F.max("default_rate_pct").alias("_hi"))
    return agg.select("attribute", "n_values", r6("_lo").alias("min_default_rate_pct"),
                      r6("_hi").alias("max_default_rate_pct"),
                      r6(F.col("_hi") - F.col("_lo")).alias("spread_points"),
                      r6(safe_div(F.col("_lo"), F.col("_hi"))).alias("min_max_ratio"))


def bias_verdict(df: DataFrame, spec: AuditSpec) -> DataFrame:
    """Verdict text from the approval ratio and the sign of the statistical
    parity difference (both on the label, as audited)."""
    gap = approval_gap(df, spec, rounded=False)
    ratio = F.col("approval_ratio")
    spd = F.col("approval_rate_unprivileged") - F.col("approval_rate_privileged")
    return gap.select(
        r6(ratio).alias("approval_ratio"),
        F.when(ratio.isNull(), F.lit(UNDEFINED)).when(ratio < DISPARATE_IMPACT_THRESHOLD, F.lit(VERDICT_BELOW))
         .when(ratio > 1 / DISPARATE_IMPACT_THRESHOLD, F.lit(VERDICT_ABOVE))
         .otherwise(F.lit(VERDICT_WITHIN)).alias("verdict"),
        F.when(ratio.isNull(), F.lit(UNDEFINED)).when((ratio >= DISPARATE_IMPACT_THRESHOLD) & (ratio <= 1 / DISPARATE_IMPACT_THRESHOLD),
               F.lit(DI_WITHIN)).otherwise(F.lit(DI_OUTSIDE)).alias("di_status"),
        F.when(spd.isNull(), F.lit(UNDEFINED)).when(spd < 0, F.lit(SPD_AGAINST_UNPRIV))
         .when(spd > 0, F.lit(SPD_AGAINST_PRIV)).otherwise(F.lit(SPD_NONE)).alias("spd_direction"))


def subgroup_cube(df: DataFrame, spec: AuditSpec, attributes: Sequence[str], min_cell: int = 30) -> DataFrame:
    """Every subset of the attributes with totals (cube), default rate
    and a ``small_cell`` flag for cells below ``min_cell`` rows (flagged, not
    dropped)."""
    attrs = list(attributes)
    y = F.col(spec.label)
    agg = df.cube(*attrs).agg(F.grouping_id().alias("grouping_id"),
                              count_if(y.isNotNull()).alias("n"), count_if(y == 1).alias("_d"))
    return agg.select(*attrs, F.col("grouping_id").cast("int").alias("grouping_id"), "n",
                      r6(safe_div(F.col("_d"), F.col("n"))).alias("default_rate"),
                      (F.col("n") < min_cell).alias("small_cell"))
