"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND = 6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Rates are compared across engines at 6 decimals."""
    return F.round(col(c).cast("double"), ROUND)


def count_if(cond: Column) -> Column:
    """Count of rows where ``cond`` holds, as BIGINT (0 for no rows)."""
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def wsum(cond: Column, weight: str | None) -> Column:
    """Weighted count of rows where ``cond`` holds (plain count without weight)."""
    if weight is None:
        return count_if(cond)
    return F.coalesce(F.sum(F.when(cond, F.col(weight)).otherwise(F.lit(0.0))), F.lit(0.0))


def safe_div(num: Column, den: Column) -> Column:
    """NULL when the denominator is 0 or NULL."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def zero_div(num: Column, den: Column) -> Column:
    """0 when the denominator is 0 (the 'zero_division=0' convention)."""
    return F.coalesce(safe_div(num, den), F.lit(0.0))


def right_closed_bins(c: str | Column, edges: Sequence[float], labels: Sequence[str],
                      open_last: bool = False) -> Column:
    """Right-closed intervals (e0,e1], (e1,e2], ...; NULL outside.

    ``Bucketizer`` is left-closed, so a boundary value would land one bin
    higher; this is a plain CASE chain instead. With ``open_last`` the last
    bin is (e_{n-1}, +inf).
    """
    x = col(c)
    expr = None
    bounds = list(zip(edges[:-1], edges[1:]))
    if open_last:
        bounds = list(zip(edges, list(edges[1:]) + [None]))
    for (lo, hi), lab in zip(bounds, labels):
        cond = (x > F.lit(lo)) if hi is None else ((x > F.lit(lo)) & (x <= F.lit(hi)))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def recode(c: str | Column, mapping: dict) -> Column:
    """Map values through ``mapping``; unmapped values become NULL."""
    x = col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(x == F.lit(k), F.lit(v)) if expr is None else expr.when(x == F.lit(k), F.lit(v))
    return expr


def md5_key(c: str | Column, salt: str) -> Column:
    """Seeded hash used for reproducible ordering (same value in DuckDB:
    ``md5(CAST(id AS VARCHAR) || salt)``)."""
    return F.md5(F.concat(col(c).cast("string"), F.lit(salt)))
